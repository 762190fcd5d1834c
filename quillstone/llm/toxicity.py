"""Toxicity by maximum-scoring segments of token log-odds.

Fitting, on a bounded sample of labelled documents:
* word counts by class give log-odds with Dirichlet priors: a word's prior is the class split of
  its six-letter beginning, whose prior is that of its four letters, whose prior is the overall
  split. Words never seen fall back along the same chain. All words of the sample are in the
  model, by 64-bit hashes, so its size is bounded by the sample alone.
* on documents kept out of the counts, the location of the best segment score of clean texts
  gives the constant of its extreme-value distribution, and a logistic curve turns a document's
  surplus over that distribution and its number of significant passages into a probability.

Scoring is one pass: each word gets its log-odds minus a drift, and one linear scan (all maximal
segments, after Ruzzo and Tompa) finds every passage whose score no extension or cut improves.
Passages beyond what chance gives in a text of that length are returned with their places.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_CHARS, Kept
from .shared import slices, staged

#: Labelled documents in the sample at most; words that a task counts before it hands them on.
SAMPLE, COUNTED = 20_000, 500_000
#: Strength of the priors, what each word costs, and the surplus that makes a passage significant.
STRENGTH, DRIFT, SIGNIFICANT = 2.0, 1.0, 3.0
_WORD = re.compile(r"\w+")
RESULT = "doc_id long, score double, predicted int, segments array<struct<start:int,end:int,score:double>>"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from all learning; a null id counts as an empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in order, in linear time.

    Runs of one sign act as one element, since no maximal segment ends inside one. `parts` holds
    candidates as (start, end, sum before, sum up to the end); a new one merges with those before
    it as long as the nearest with a smaller sum before it ends below it. `back` links each
    candidate to that one, so that every step is paid for once.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(positive)) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(scores)]])
    sums = np.add.reduceat(scores, starts)
    parts: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for start, end, value in zip(starts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        before, total = total, total + value
        if value <= 0:
            continue
        left, right = before, total
        while True:
            j = len(parts) - 1
            while j >= 0 and parts[j][2] >= left:
                j = parts[j][4]
            if j < 0 or parts[j][3] >= right:
                parts.append((start, end, left, right, j))
                break
            start, left = parts[j][0], parts[j][2]
            del parts[j:]
    return [(s, e, r - lo) for s, e, lo, r, _ in parts]


#: Tables of counts: whole words, their first six and first four letters.
WORDS, LONG, SHORT = range(3)


def keys_of(word: str) -> tuple[int, int, int]:
    """A word's keys in the three tables."""
    return tuple(xxhash.xxh3_64_intdigest(w.encode()) for w in (word, word[:6], word[:4]))


@dataclass
class Counts:
    """Clean and toxic occurrences by key, keys sorted."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    seen: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.uint32))

    def get(self, keys: np.ndarray) -> np.ndarray:
        """(clean, toxic) of each key."""
        out = np.zeros((len(keys), 2))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            out[known] = self.seen[at[known]]
        return out


@dataclass
class Model:
    """Class counts of words and beginnings, and the calibration."""

    tables: list[Counts] = field(default_factory=lambda: [Counts(), Counts(), Counts()])
    share: float = 0.5  # of toxic words among all
    rate: float = 1.0  # of the extreme-value distribution
    constant: float = 0.0  # log K
    curve: tuple[float, float, float] = (-2.0, 0.0, 0.0)

    def log_odds(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) / P(word | clean) of each word, smoothed along the chain of beginnings."""
        keys = np.array([*map(keys_of, words)], np.uint64).reshape(-1, 3)
        toxic = np.full(len(words), self.share)
        for table in (SHORT, LONG, WORDS):
            seen = self.tables[table].get(keys[:, table])
            toxic = (seen[:, 1] + STRENGTH * toxic) / (seen.sum(axis=1) + STRENGTH)
        return np.log(toxic / (1 - toxic)) - math.log(self.share / (1 - self.share))


class Scores(Kept):
    """Word scores, with the drift taken off."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def make(self, word: str) -> float:
        return float(self.model.log_odds([word])[0]) - DRIFT

    def learn(self, words: set[str]) -> None:
        """Make the scores of words not met before, all at once."""
        new = sorted(w for w in words if len(w) <= CACHE_CHARS and w not in self and w not in self.older)
        for w, x in zip(new, (self.model.log_odds(new) - DRIFT).tolist(), strict=True):
            self.keep(w, x)


def segments_of(texts: list[str | None], scores: Scores) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """For each text the number of words, and maximal segments as word ranges."""
    found = [_WORD.findall((t or "").lower()) for t in texts]
    scores.learn({w for words in found for w in words})
    return [(len(words), maximal_segments(np.fromiter(map(scores.__getitem__, words), np.float64, len(words)))) for words in found]


def evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> tuple[float, float, list[tuple[int, int, float]]]:
    """Largest surplus over chance (as asinh), log of the significant passages' number, and those passages.

    A text without segments has the surplus of an empty one, which scores 0.
    """
    chance = model.constant + math.log(max(n, 1))
    surplus = [(s, e, model.rate * v - chance) for s, e, v in found]
    far = [x for x in surplus if x[2] > SIGNIFICANT]
    return math.asinh(max([-chance, *(x[2] for x in surplus)])), math.log1p(len(far)), far


def _counts(texts: DataFrame) -> DataFrame:
    """(kind, key, clean, toxic): occurrences of words and beginnings in (text, toxic) rows."""

    def run(batches):
        seen: dict[str, list[int]] = {}

        def flush():
            counts = np.array([*seen.values()], np.int64).reshape(-1, 2)
            keys = np.array([keys_of(w) for w in seen], np.uint64).astype(np.int64).reshape(-1, 3)
            kinds = np.repeat(np.arange(3, dtype=np.int32), len(counts))
            return pa.RecordBatch.from_pydict({"kind": kinds, "key": keys.T.reshape(-1), "clean": np.tile(counts[:, 0], 3), "toxic": np.tile(counts[:, 1], 3)})

        for b in slices(batches):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in _WORD.findall((text or "").lower()):
                    seen.setdefault(w, [0, 0])[toxic] += 1
            if len(seen) >= COUNTED:
                yield flush()
                seen = {}
        yield flush()

    each = texts.mapInArrow(run, "kind int, key long, clean long, toxic long")
    return each.groupBy("kind", "key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic curve, by Newton steps with a small ridge."""
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents that are not held out: at most `sample`, those whose ids hash lowest.

    Three quarters of the sample give the counts, one quarter the calibration. Without toxic or
    without clean documents in the sample the model knows no words and scores all texts alike.
    The counts that come to the driver are those of the words of the sample, 24 bytes for each.
    """
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = [(r.doc_id, r.toxic) for r in chosen.collect()]  # at most `sample`
    small = F.broadcast(docs.sparkSession.createDataFrame(rows, "doc_id long, toxic int"))
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(4)) == 0
    picked = staged(docs.select("doc_id", "text").join(small, "doc_id").select("text", "toxic", aside.alias("aside")))
    counts = _counts(picked.where("NOT aside").select("text", "toxic")).toArrow()
    kinds, keys, clean, toxic = (counts.column(i).to_numpy() for i in range(4))
    model = Model()
    for kind in (WORDS, LONG, SHORT):
        own = kinds == kind
        order = np.argsort(keys[own].astype(np.uint64))
        model.tables[kind] = Counts(keys[own].astype(np.uint64)[order], np.stack([clean[own], toxic[own]], axis=1)[order].astype(np.uint32))
    del counts, kinds, keys, clean, toxic
    n_clean, n_toxic = model.tables[WORDS].seen.sum(axis=0, dtype=np.int64).tolist()
    if not n_clean or not n_toxic:
        return Model()
    model.share = n_toxic / (n_clean + n_toxic)
    texts = picked.where("aside").select("text", "toxic")

    def best(batches):
        """Words, and score of the best segment (null without one), of each text."""
        scores = Scores(model)
        for b in slices(batches):
            found = segments_of(b.column(0).to_pylist(), scores)
            top = [max((v for _, _, v in segments), default=None) for _, segments in found]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(top, pa.float64()), b.column(1)], names=["n", "best", "toxic"])

    def shown(batches):
        """Evidence of each text, under the calibrated distribution."""
        scores = Scores(model)
        for b in slices(batches):
            found = [evidence(*x, model)[:2] for x in segments_of(b.column(0).to_pylist(), scores)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.float64()), b.column(1)], names=["most", "n_far", "toxic"])

    calibrate(model, [(r.n, r.best) for r in texts.mapInArrow(best, "n long, best double, toxic int").collect() if not r.toxic])
    seen = texts.mapInArrow(shown, "most double, n_far double, toxic int").collect()
    if 0 < sum(r.toxic for r in seen) < len(seen):
        x = np.array(sorted((1.0, r.most, r.n_far, float(r.toxic)) for r in seen))
        model.curve = tuple(float(v) for v in _logistic(x[:, :3], x[:, 3]))
    return model


def calibrate(model: Model, clean: list[tuple[int, float | None]]) -> None:
    """Set rate and constant of the extreme-value law from (words, best segment's score) of clean documents.

    The best segment of n words follows a Gumbel law located at (constant + log n) / rate. Its
    rate comes from the spread of the middle half, as toxic words of mislabelled documents would
    widen the whole; the constant from the median. Under 20 documents with a segment set nothing.
    """
    known = np.array([(math.log(n), best) for n, best in clean if n and best is not None])
    if len(known) >= 20:
        low, high = np.quantile(known[:, 1], [0.25, 0.75])
        spread = max(high - low, 0.1) / (math.log(math.log(4)) - math.log(math.log(4 / 3)))
        model.rate = min(1.0, 1 / spread)
        model.constant = float(np.median(model.rate * known[:, 1] - known[:, 0])) + math.log(math.log(2))


def probabilities(texts: list[str | None], scores: Scores, model: Model) -> list[tuple[float, list[tuple[int, int, float]]]]:
    """Each text's score and its significant passages as word ranges."""
    a, b, c = model.curve
    out = []
    for n, found in segments_of(texts, scores):
        most, count, far = evidence(n, found, model)
        out.append((1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * most + c * count)))), far))
    return out


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text scores below one half.

    Null and empty texts are scored like any text, by the weakest evidence, and stay as long as
    that is below one half; nulls in other columns do not matter; each of repeated rows stays or
    goes as the others do; all words of a text count; an empty table gives no rows; further
    columns, also such as score or segments, go through as they are.
    """

    def run(batches):
        scores = Scores(model)
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([p < 0.5 for p, _ in probabilities(texts, scores, model)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, score (0 to 1), predicted (1 from 0.5 on), segments (code-point ranges).

    A null or empty text, or one without words, has no segments and the score of the weakest
    evidence; a null doc_id stays null; repeated rows each keep their row; an empty table gives no
    rows; other columns are not read. All words of a text count, however long it is.
    """

    def run(batches):
        scores = Scores(model)
        for batch in slices(batches):
            out, spans = [], []
            texts = batch.column(1).to_pylist()
            for text, (p, far) in zip(texts, probabilities(texts, scores, model), strict=True):
                out.append(p)
                if far:
                    places = [m.span() for m in _WORD.finditer(text.lower())]
                    far = [{"start": places[s][0], "end": places[e - 1][1], "score": v} for s, e, v in far]
                spans.append(far)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32()), pa.array(spans, kind)],
                names=["doc_id", "score", "predicted", "segments"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)
