"""Settings of the clause engine: patterns, weights and names that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

# ---- fixed values: each must be exactly this for right results ----

#: Ligatures that are spelled out before Unicode normalisation.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "ft"}

#: Characters that end a line, as a regular expression.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: The characters among them, as the inside of a character class.
LINE_BREAK_CHARACTERS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"

#: Spaces that typesetting leaves inside words.
EXOTIC_SPACES = r"[\u00A0\u2007\u202F\u2009\u200A]"

#: Lines that are footers: page numbers and stamps.
FOOTERS = (
    r"(?iuUd)^\s*Page\s+\d+\s*(of\s+\d+)?\s*$",
    r"(?Ud)^\s*\d+\s*$",
    r"(?Ud)^\s*[-–—]\s*\d+\s*[-–—]\s*$",
    r"(?iuUd)^\s*CONFIDENTIAL\s*$",
    r"(?iuUd)^\s*DRAFT\s*$",
)

#: Numbered markers; the group named num is the number.
NUMBERING = (
    r"(?:^|\n|(?<=\.\s)|(?<=\n))(?P<num>\d+(?:\.\d+)+)\.?\s",
    r"(?:^|\n|(?<=\.\s)|(?<=\n))(?P<num>\d+)\.\s",
    r"(?P<num>\([ivxlcIVXLC]+\))\s",
    r"(?:^|\n)\s*(?P<num>[IVXLC]{1,5})\.\s",
    r"(?P<num>\([a-z]\))\s",
    r"(?:^|\n)\s*(?P<num>[a-z]\.)\s",
    r"(?P<num>ARTICLE\s+[IVXLC]+)\b",
    r"(?P<num>Section\s+\d+(?:\.\d+)*)\b",
    r"(?P<num>Clause\s+\d+(?:\.\d+)*)\b",
)

#: Structural markers at line starts, and the role of what follows.
STRUCTURAL = (
    (r"^\s*WHEREAS\b", "RECITAL"),
    (r"^\s*NOW,?\s+THEREFORE\b", "RECITAL"),
    (r"^\s*BY\s+AND\s+BETWEEN\b", "PARTIES"),
    (r"^\s*IN\s+WITNESS\s+WHEREOF\b", "SIGNATURE"),
    (r"^\s*WITNESSETH\b", "RECITAL"),
    (r"^\s*RECITALS?\b", "RECITAL"),
)

#: Roles that are never classified or scored.
STRUCTURAL_ROLES = ("PARTIES", "RECITAL", "SIGNATURE", "PREAMBLE")

#: Risky wording: pattern (case does not matter), weight, tag.
LEXICON = (
    (r"\bsolo?\s+discretion\b", 0.9, "unilateral-discretion"),
    (r"\bsole\s+(?:and\s+absolute\s+)?discretion\b", 0.9, "unilateral-discretion"),
    (r"\bat\s+any\s+time\b", 0.5, "unilateral-timing"),
    (r"\bwith\s+or\s+without\s+cause\b", 0.8, "no-cause"),
    (r"\bwithout\s+(?:prior\s+)?notice\b", 0.7, "no-notice"),
    (r"\bwithout\s+(?:any\s+)?liabilit(?:y|ies)\b", 0.8, "no-liability"),
    (r"\bwithout\s+limitation\b", 0.5, "unlimited-scope"),
    (r"\bany\s+and\s+all\b", 0.5, "unlimited-scope"),
    (r"\bwhatsoever\b", 0.4, "unlimited-scope"),
    (r"\bin\s+perpetuity\b", 0.9, "perpetual"),
    (r"\birrevocably\b", 0.5, "irrevocable"),
    (r"\bwaive[sd]?\s+(?:all|any)\b", 0.6, "waiver"),
    (r"\bno\s+waiver\b", 0.3, "waiver"),
    (r"\bautomatically?\s+renew", 0.7, "auto-renew"),
    (r"\bevergreen\b", 0.7, "auto-renew"),
    (r"\bnon-?compet(?:e|ition)\b", 0.6, "non-compete"),
    (r"\bnon-?solicit\b", 0.5, "non-solicit"),
    (r"\birrevocably\s+assign", 0.7, "assignment"),
    (r"\bwithout\s+(?:additional\s+)?compensation\b", 0.6, "uncompensated"),
    (r"\bimmediately\s+upon\b", 0.5, "immediate"),
    (r"\bhold\s+harmless\b", 0.5, "indemnify"),
    (r"\bshall\s+not\b.{0,40}\bcompete\b", 0.75, "non-compete"),
    (r"\bnot\s+engage\b.{0,60}\bcompeting\b", 0.7, "non-compete"),
    (r"\banywhere\s+in\b", 0.45, "non-compete"),
    (r"\bthroughout\s+the\s+world\b", 0.55, "non-compete"),
    (r"\b(?:five|ten|7|8|9|10)\s*\(?\s*(?:five|ten|seven|eight|nine|ten)\s*\)?\s*years?\b", 0.55, "long-duration"),
    (r"\bfor\s+a\s+period\s+of\s+(?:five|ten|seven|eight|nine|10)\b", 0.55, "long-duration"),
    (r"\bshall\s+(?:be\s+)?automatically?\s+(?:renew|extend)", 0.8, "auto-renew"),
    (r"\b(?:one|two)\s+hundred\s+(?:eighty|ninety|twenty|forty|sixty)\s*\(?\s*1?8?0?\s*\)?\s*days?\b", 0.6, "long-notice"),
    (r"\b(?:90|120|180|270|365)\s*\([^)]+\)\s*days?\b", 0.55, "long-notice"),
    (r"\bsole\s+discretion\b", 0.9, "unilateral-discretion"),
    (r"\bwithout\s+(?:prior\s+)?notice\b", 0.7, "no-notice"),
    (r"\bmay\s+(?:at\s+its\s+option\s+)?(?:unilaterally|modify|amend|change)", 0.55, "unilateral-change"),
    (r"\bshall\s+have\s+the\s+right\s+to\b.{0,30}\bsuspend\b", 0.65, "unilateral-suspension"),
    (r"\bwaive[sd]?\b", 0.45, "waiver"),
    (r"\bwaives?\s+all\b", 0.65, "waiver"),
)

#: Wording of unfilled forms; case matters.
PLACEHOLDERS = (r"<<[^>]+>>", r"_{4,}", r"\[INSERT[^\]]*\]")

#: Category of each tag; tags that are missing have none.
TAG_CATEGORY = {
    "unilateral-discretion": "Operational", "unilateral-timing": "Operational", "no-cause": "Legal", "no-notice": "Operational",
    "no-liability": "Legal", "unlimited-scope": "Legal", "perpetual": "Legal", "irrevocable": "Legal", "waiver": "Legal",
    "auto-renew": "Operational", "non-compete": "Operational", "non-solicit": "Operational", "assignment": "Financial",
    "uncompensated": "Financial", "immediate": "Operational", "indemnify": "Legal",
}

#: Categories of labels, in the order in which they are given.
LABEL_CATEGORY = {
    "Legal": (
        "Indemnifications", "Indemnity", "Liabilities", "Terminations", "Intellectual Property", "Warranties", "Representations",
        "Enforceability", "Binding Effects", "Assignments", "Assigns", "Specific Performance", "Remedies", "Enforcements",
        "Waiver Of Jury Trials", "Governing Laws", "Arbitration", "Jurisdictions", "Venues",
    ),
    "Financial": (
        "Payments", "Fees", "Expenses", "Costs", "Taxes", "Tax Withholdings", "Withholdings", "Base Salary", "Benefits", "Insurances",
        "Financial Statements", "Solvency", "Liens", "Interests",
    ),
    "Operational": (
        "Notices", "Cooperation", "Duties", "Records", "Compliance With Laws", "Consents", "Approvals", "Authorizations", "Publicity",
        "Non-Disparagement", "Confidentiality", "Disclosures", "Effective Dates", "Employment", "Vacations", "Positions",
    ),
}
CATEGORIES = ("Financial", "Legal", "Operational", "Ambiguity")

#: What a label multiplies the score by; labels that are missing leave it.
LABEL_MULTIPLIER = {
    "Indemnifications": 1.30, "Indemnity": 1.30, "Terminations": 1.25, "Governing Laws": 1.20, "Arbitration": 1.15,
    "Intellectual Property": 1.20, "Warranties": 1.10, "Representations": 1.10, "Enforceability": 1.15, "Binding Effects": 1.15,
    "Confidentiality": 1.10, "Insurances": 1.10, "Liabilities": 1.30, "Specific Performance": 1.20, "Remedies": 1.15,
    "Notices": 0.80, "Counterparts": 0.70, "Headings": 0.60, "Severability": 0.75, "Further Assurances": 0.80,
    "Entire Agreements": 0.85, "Amendments": 0.85, "Waivers": 0.85,
}

#: Phrases of the sentence that says why a clause got its score.
HINTS = {
    "label": "'{}' clause",
    "unlabelled": "Unlabeled clause",
    "high": "HIGH RISK",
    "medium": "moderate risk",
    "tags": "risky language: {}",
    "override": "score floored by substantive-risk override ({})",
    "form": "form-field clause (mostly placeholders)",
    "unsure": "classifier uncertain (conf={})",
    "floor": "classifier uncertain (conf={}) — no risky language detected",
    "far": "significantly different from standard ({} deviation)",
    "off": "somewhat different from standard ({} deviation)",
    "mismatch": "classifier and reference-bank disagree",
    "short": "short clause (fragment)",
    "structural": "Structural clause ({}); not scored for semantic risk.",
    "between": " — ",
}

#: Headings that a provider's reply is read by.
REPLY_HEADINGS = ("EXPLANATION:", "SUGGESTED ACTION:")

# ---- end of fixed values ----


@dataclass(frozen=True)
class Settings:
    """All tunables; the defaults are those that results are compared under."""

    extensions: tuple[str, ...] = ("pdf", "docx", "txt")
    min_text_length: int = 100
    max_upload_bytes: int = 20 * 1024 * 1024
    # cleaning
    min_page_fraction: float = 0.5
    min_repeat_pages: int = 1  # 2 spares two-page documents, whose every line would count as repeated
    # segmentation
    numbering: tuple[str, ...] = NUMBERING
    structural: tuple[tuple[str, str], ...] = STRUCTURAL
    overlap_window: int = 5
    min_clause_length: int = 20
    min_clause_words: int = 4
    max_level: int = 5
    normalize_quotes: bool = True
    normalize_dashes: bool = True
    ellipsis_drift: bool = True  # positions after an ellipsis are those of the expanded text
    deal_parts: bool = False  # True deals the parts of very long texts over tasks, for one more exchange
    keep_preamble: bool = False  # True gives text before the first marker a clause of its own
    # classification
    top_k: int = 3
    context_chars: int = 200
    context_skip_number_prefix: bool = False  # True keeps "1. " from being a whole context
    # comparison
    neighbours: int = 5
    bank_per_label: int = 5
    bank_diversity: float = 0.85
    # scoring
    lexicon: tuple[tuple[str, float, str], ...] = LEXICON
    placeholders: tuple[str, ...] = PLACEHOLDERS
    weights: dict[str, float] = field(default_factory=lambda: {"deviation": 0.4, "uncertainty": 0.4, "mismatch": 0.2, "language": 0.4})
    low: float = 0.30
    medium: float = 0.50
    high: float = 0.70
    min_confidence: float = 0.25
    override_medium: float = 0.65
    override_high: float = 0.85
    lexicon_dedupe_tags: bool = False  # True counts each tag once, with its largest weight
    tag_categories_at_low: bool = True
    # explanation
    explain_at: str = "medium"
    max_retries: int = 2

    def with_(self, **changes: Any) -> Settings:
        return replace(self, **changes)


def load_settings(path: str) -> Settings:
    """Settings from a YAML or JSON file of field names; fields that it lacks keep their defaults."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        values = json.loads(text)
    else:
        import yaml

        values = yaml.safe_load(text) or {}
    frozen = lambda v: tuple(frozen(x) for x in v) if isinstance(v, list) else v
    return Settings(**{k: frozen(v) for k, v in values.items()})


DEFAULT = Settings()
