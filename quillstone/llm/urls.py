"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from the URLs that the rules label, a bounded sample of them, on the driver. Every
suffix of the sample has a statistic of its own; these tables, no longer than the sample, are
broadcast, and the trees become column expressions, so all rows are judged inside Spark's
generated code, in one pass without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled URLs that the trees are fitted on, at most (those with the smallest hashes).
SAMPLE = 20_000
#: Parts of the sample; the suffix statistics that trees learn from come from the other parts.
FOLDS = 5
TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.2, 32, 20


@dataclass(frozen=True)
class Rule:
    """`verdict` for `host` and all its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The index of the longest rule that fits, or null."""
    found = F.lit(None).cast("int")
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i].host + rules[i].path), rules[i].host, i))
    for i in order:  # the longest is wrapped last and so is asked first
        r = rules[i]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """The parts of a URL whose block rates are features."""
    return {
        "domain": F.regexp_extract(host, r"([^.]*)\z", 1),
        "registered": F.regexp_extract(host, r"([^.]*\.[^.]*)\z", 1),
        "file": F.regexp_extract(path, r"(\.[^./]*)\z", 1),
        "section": F.regexp_extract(path, r"\A/([^/]*)", 1),
    }


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers that describe the spelling of a URL; null and empty URLs give zeros."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    count = lambda text, part: (F.length(text) - F.length(F.replace(text, F.lit(part)))).cast("double")
    share = lambda c: (F.length(u) - F.length(F.replace(u, c))) / F.length(c) / n
    letters = F.filter(F.array_distinct(F.split(u, "")), lambda c: c != "")
    return {
        "length": F.length(u).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]+")).cast("double"),
        "labels": count(host, "."),
        "digits": F.length(F.regexp_replace(u, "[^0-9]", "")) / n,
        "path_digits": F.length(F.regexp_replace(path, "[^0-9]", "")).cast("double"),
        "entropy": F.aggregate(letters, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c))),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "hyphens": count(u, "-"),
        "secure": F.lower(F.substring(u, 1, 6)).eqNullSafe("https:").cast("double"),
        "fragment": F.contains(u, F.lit("#")).cast("double"),
    }


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass
class Boosted:
    """Trees over named features; a tree is nested (feature, threshold, below, above) or a number."""

    base: float = 0.0
    trees: list = field(default_factory=list)
    #: kind of suffix -> suffix -> smoothed log odds of "block"
    rates: dict[str, dict[str, float]] = field(default_factory=dict)
    prior: float = 0.0

    def with_rates(self, df: DataFrame, parts: dict[str, Column]) -> DataFrame:
        """`df` with a column f_<kind>_rate for each kind of suffix; suffixes not in the sample have the prior."""
        for kind, part in parts.items():
            known = [*self.rates.get(kind, {}).items()]
            table = df.sparkSession.createDataFrame(known, "_suffix string, _rate double")
            joined = df.withColumn("_suffix", part).join(F.broadcast(table), "_suffix", "left")  # at most a row for each row of the sample
            df = joined.withColumn(f"f_{kind}_rate", F.coalesce("_rate", F.lit(self.prior))).drop("_suffix", "_rate")
        return df

    def score(self, features: dict[str, Column]) -> Column:
        """Probability of "block"."""

        def walk(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            name, threshold, below, above = tree
            return F.when(features[name] <= threshold, walk(below)).otherwise(walk(above))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + walk(tree)
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, names: list[str], cuts: list[np.ndarray], codes: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
    """A regression tree on gradients `g` and hessians `h`, by histograms of binned features."""
    value = -g[rows].sum() / (h[rows].sum() + 1.0) * RATE
    if depth == 0 or len(rows) < 2 * LEAST:
        return value
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best, best_gain = None, 1e-6
    for j in range(x.shape[1]):
        if not len(cuts[j]):
            continue
        code, bins = codes[rows, j], len(cuts[j]) + 1
        below = [np.cumsum(np.bincount(code, w, bins))[:-1] for w in (g[rows], h[rows], None)]
        gain = below[0] ** 2 / (below[1] + 1) + (total_g - below[0]) ** 2 / (total_h - below[1] + 1) - total_g**2 / (total_h + 1)
        gain[(below[2] < LEAST) | (len(rows) - below[2] < LEAST)] = 0
        k = int(gain.argmax())
        if gain[k] > best_gain:
            best, best_gain = (j, k), gain[k]
    if best is None:
        return value
    j, k = best
    under = codes[rows, j] <= k
    args = (x, names, cuts, codes, g, h)
    return names[j], float(cuts[j][k]), _tree(*args, rows[under], depth - 1), _tree(*args, rows[~under], depth - 1)


def boost(x: np.ndarray, names: list[str], y: np.ndarray) -> tuple[float, list]:
    """Gradient boosting for log loss: the base score and the trees."""
    p = (y.sum() + 1) / (len(y) + 2)
    base = _logit(p)
    if not len(y) or y.min() == y.max():
        return base, []
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1), method="nearest"))
        cuts.append((values[1:] + values[:-1]) / 2)
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score, trees, rows = np.full(len(y), base), [], np.arange(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, names, cuts, codes, p - y, p * (1 - p), rows, DEPTH)
        trees.append(tree)
        score = score + evaluate(tree, x, names)
    return base, trees


def evaluate(tree, x: np.ndarray, names: list[str]) -> np.ndarray:
    """A tree's values for rows of features."""
    if not isinstance(tree, tuple):
        return np.full(len(x), float(tree))
    name, threshold, below, above = tree
    return np.where(x[:, names.index(name)] <= threshold, evaluate(below, x, names), evaluate(above, x, names))


def suffix_rates(suffix: pd.Series, y: np.ndarray, prior: float) -> dict[str, float]:
    """Smoothed log odds of "block" for each suffix."""
    counts = pd.Series(y, suffix.index).groupby(suffix).agg(["sum", "size"])
    return {str(s): _logit((b + 4 * prior) / (n + 4)) for s, b, n in counts.itertuples()}


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Boosted:
    """Fit on different (url, block 0/1) rows: at most `sample`, those whose URLs hash lowest, come to the driver.

    Repeated rows count once, so that one frequent URL cannot fill the sample.
    """
    host, path = host_and_path(F.col("url"))
    numbers, parts = lexical(F.col("url"), host, path), suffixes(host, path)
    chosen = labelled.select("url", "block").distinct().orderBy(F.xxhash64("url"), "url", "block").limit(sample)
    rows = chosen.select("block", *[c.alias(n) for n, c in numbers.items()], *[c.alias(n) for n, c in parts.items()]).toPandas()
    y = rows["block"].to_numpy(float)
    prior = (y.sum() + 1) / (len(y) + 2)
    model, columns = Boosted(prior=_logit(prior)), [rows[n].to_numpy(float) for n in numbers]
    fold = np.arange(len(y)) % FOLDS  # rows come in the order of their hashes
    for kind in parts:
        model.rates[kind] = suffix_rates(rows[kind], y, prior)
        column = np.full(len(y), model.prior)
        for k in range(FOLDS):
            others = suffix_rates(rows[kind][fold != k], y[fold != k], prior)
            column[fold == k] = rows[kind][fold == k].map(others).fillna(model.prior)
        columns.append(column)
    x = np.stack(columns, axis=1) if len(y) else np.zeros((0, len(columns)))
    model.base, model.trees = boost(x, [*numbers, *(f"{k}_rate" for k in parts)], y)
    return model


def judge(pages: DataFrame, rules: list[Rule], sample: int = SAMPLE) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict ("allow" or "block") and score of "block".

    The longest rule that fits decides (of rules of one length that with the greater host, and of
    equal ones the last given); where none fits, the trees do, which have learned from a
    sample of the URLs that rules decide. Without any such URL all scores are one half and the
    verdict is "allow"; if rules give a single verdict, the trees follow it. A null URL, or one
    without `://`, has an empty host and path. Repeated rows each keep their row, a null page_id
    stays null, an empty table gives no rows, other columns are not read.
    """
    url = F.col("url")
    host, path = host_and_path(url)
    rule = matching_rule(host, path, rules)
    verdicts = F.array(*[F.lit(r.verdict) for r in rules])
    names = F.array(*[F.lit(r.host + r.path) for r in rules])
    by_rule = pages.select("page_id", "url", host.alias("host"), path.alias("path"), rule.alias("i"))
    model = fit(by_rule.where(F.col("i").isNotNull()).select("url", (F.get(verdicts, F.col("i")) == "block").cast("int").alias("block")), sample)
    host, path = F.col("host"), F.col("path")
    described, parts = lexical(url, host, path), suffixes(host, path)
    # features become columns first, so that each is computed once for all trees
    wide = model.with_rates(by_rule.select("*", *[c.alias(f"f_{n}") for n, c in described.items()]), parts)
    score = model.score({n: F.col(f"f_{n}") for n in [*described, *(f"{k}_rate" for k in parts)]})
    return (
        wide.withColumn("score", score)
        .withColumn("rule", F.get(names, F.col("i")))
        .withColumn("verdict", F.coalesce(F.get(verdicts, F.col("i")), F.when(F.col("score") > 0.5, "block").otherwise("allow")))
        .select("page_id", "host", "path", "rule", "verdict", "score")
    )
