"""Language identification of code-switched text by a linear-chain conditional random field.

Every word of a line is a position of a chain whose states are languages. A word's potential sums
learned weights of its features: prefixes and suffixes, character n-grams, and the word itself
(the lexicon). Learned transition weights join neighbours. Forward-backward gives the probability
of each language for each word; a document's language is the one with most expected words.

Chains of many lines advance together, one position at a time, in array operations. Weights are
fitted on a bounded sample by gradient ascent on the likelihood of the words' labels, whose
gradient comes from the same forward-backward pass. Lines of the sample bear one language each;
part of the training chains are joined from pieces of lines of different languages, so that
transition weights are learned from words that stay and words that switch.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import slices
from .toxicity import held_out

#: Documents of each language in the sample; words of one of them at most.
SAMPLE, SAMPLE_WORDS = 250, 1_500
#: Feature slots; positions of a chain at most; words that a worker keeps, of up to 16 languages.
SLOTS, CHAIN, CACHE = 1 << 17, 256, 500_000
#: Positions times states that advance together, in scoring and in training.
CELLS, TRAIN_CELLS = 1 << 22, 1 << 19
#: Share of a word's n-grams of three that training must have met in the word's language for the word to be familiar.
MET = 0.7
#: One in so many training chains is followed by one that joins it with another language; words of each piece at most.
JOINED, PIECE = 3, 12
#: Letters of a word whose features are held at once; words whose potentials are made together.
PART, LEARNED = 4_096, 10_000
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def feature_parts(word: str) -> Iterator[tuple[list[int], int]]:
    """Hashes of a word's features, those of a very long word in parts: the word, affixes of one to
    three letters, n-grams of two and three; and how many of the last ones are n-grams of three."""
    names = [f"w{word}"]
    for k in (1, 2, 3):
        names += (f"p{word[:k]}", f"s{word[-k:]}")
    if len(word) <= PART:
        marked = f"^{word}$"
        names += [marked[i : i + 2] for i in range(len(marked) - 1)]
        names += [marked[i : i + 3] for i in range(len(marked) - 2)]
        yield [zlib.crc32(n.encode()) for n in names], len(word)
        return
    for at in range(0, len(word), PART):  # a part's n-grams are those that begin in it
        marked = ("^" if at == 0 else word[at - 1]) + word[at : at + PART + 1]
        if at + PART >= len(word):
            marked += "$"
        first = min(len(word), at + PART) - at + (at + PART >= len(word))
        threes = [marked[i : i + 3] for i in range(first) if i + 3 <= len(marked)]
        names += [marked[i : i + 2] for i in range(first) if i + 2 <= len(marked)] + threes
        yield [zlib.crc32(n.encode()) for n in names], len(threes)
        names = []


def features(word: str) -> list[int]:
    """All slots of a word's features."""
    return [h % SLOTS for part, _ in feature_parts(word) for h in part]


def chains(text: str) -> list[list[str]]:
    """The words of each line, in runs of at most CHAIN words."""
    found = (_WORD.findall(line) for line in text.lower().splitlines())
    return [words[i : i + CHAIN] for words in found for i in range(0, len(words), CHAIN)]


def forward_backward(potentials: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals [position, state], expected transitions [state, state] and log likelihood's normaliser.

    `potentials` holds the log potentials of all chains end to end. Chains are ordered by length,
    so that those still running are always the first ones.
    """
    n, states = potentials.shape
    top = potentials.max(axis=1, keepdims=True) if n else potentials
    local, step = np.exp(potentials - top), np.exp(transitions - transitions.max())
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    running = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
    ahead, scale = np.empty_like(local), np.empty(n)
    now = None
    for t, k in enumerate(running.tolist()):
        at = start[:k] + t
        now = local[at] if now is None else (now[:k] @ step) * local[at]
        total = now.sum(axis=1)
        now = now / total[:, None]
        ahead[at], scale[at] = now, total
    marginals, moves = np.empty_like(local), np.zeros((states, states))
    later = np.zeros((0, states))
    for t in range(len(running) - 1, -1, -1):
        k = int(running[t])
        at = start[:k] + t
        back = np.ones((k, states))
        m = len(later)
        if m:
            onward = later * local[at[:m] + 1] / scale[at[:m] + 1, None]
            back[:m] = onward @ step.T
            moves += (ahead[at[:m]].T @ onward) * step
        marginals[at] = ahead[at] * back
        later = back
    return marginals, moves, float(np.log(scale).sum() + top.sum() + (n - len(lengths)) * transitions.max())


def blocks(lengths: np.ndarray, states: int, cells: int) -> list[tuple[int, int, int, int]]:
    """Runs of chains (first, after the last, and the same of positions) of about `cells` positions times states."""
    ends = np.cumsum(lengths)
    out, first, at = [], 0, 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, at + cells // states, side="right")))
        out.append((first, last, at, int(ends[last - 1])))
        first, at = last, int(ends[last - 1])
    return out


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((SLOTS, 0), np.float32))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    #: The n-grams of three that training met, in order, and for each of them a bit for every language it was met in.
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    bits: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.uint8))

    def met(self, hashes: np.ndarray) -> np.ndarray:
        """[hash, language]: whether training met the n-gram in the language."""
        if not len(self.grams):
            return np.zeros((len(hashes), len(self.languages)), np.uint8)
        at = np.minimum(np.searchsorted(self.grams, hashes), len(self.grams) - 1)
        return np.unpackbits(self.bits[at] * (self.grams[at] == hashes)[:, None], axis=1, count=len(self.languages))


class Lexicon:
    """Log potentials of words, made on first sight; emptied between batches when too large."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.held = np.zeros((0, len(self.model.languages)))  # potentials by word, with room for more
        self.familiar = np.zeros((0, len(self.model.languages)), bool)  # whether a word looks like one of a language

    def learn(self, words: set[str]) -> None:
        """Make the potentials of words not met before, many at a time."""
        new = sorted(w for w in words if w not in self.row)
        for at in range(0, len(new), LEARNED):
            part = new[at : at + LEARNED]
            # a run of hashes for each word, and for each part of a very long one; the last `threes` of it are n-grams of three
            hashes, sizes, threes, owner = array("I"), [], [], []
            states = self.model.weights.shape[1]
            rows, met, n = np.zeros((len(part), states), np.float32), np.zeros((len(part), states), np.int32), np.zeros(len(part), np.int32)

            def flush():
                flat, start, tail, of = np.frombuffer(hashes, np.uint32), np.cumsum(sizes) - sizes, np.array(threes), np.array(owner)
                np.add.at(rows, of, np.add.reduceat(self.model.weights[flat % np.uint32(SLOTS)], start, axis=0))
                last = np.repeat(start + sizes - np.cumsum(tail), tail) + np.arange(tail.sum())
                found, begins = self.model.met(flat[last]), np.cumsum(tail) - tail
                some = tail > 0
                if some.any():
                    np.add.at(met, of[some], np.add.reduceat(found, begins[some], axis=0, dtype=np.int32))
                np.add.at(n, of, tail)

            for i, w in enumerate(part):
                for run, tail in feature_parts(w):
                    hashes.extend(run)
                    sizes.append(len(run))
                    threes.append(tail)
                    owner.append(i)
                    if len(hashes) > 1 << 18:
                        flush()
                        hashes, sizes, threes, owner = array("I"), [], [], []
            if sizes:
                flush()
            first = len(self.row)
            for w in part:
                self.row[w] = len(self.row)
            if len(self.row) > len(self.held):
                room = np.zeros((len(self.row) + len(self.row) // 2, rows.shape[1]))
                room[:first] = self.held[:first]
                known = np.zeros(room.shape, bool)
                known[:first] = self.familiar[:first]
                self.held, self.familiar = room, known
            self.held[first : len(self.row)] = rows
            self.familiar[first : len(self.row)] = met >= MET * n[:, None]

    def numbers(self, words: list[str]) -> list[int]:
        try:
            return [*map(self.row.__getitem__, words)]
        except KeyError:
            self.learn(set(words))
            return [*map(self.row.__getitem__, words)]

    def table(self) -> np.ndarray:
        """All potentials so far."""
        return self.held[: len(self.row)]

    def trim(self) -> None:
        if len(self.row) * max(16, len(self.model.languages)) > CACHE * 16:
            self.clear()


def predict(texts: list[str | None], model: Model, lexicon: Lexicon) -> tuple[list[str], list[float], list[float]]:
    """Language, its share of the expected words, and the share of words that look like words of their language, for each text."""
    numbers, lengths, owner, letters = [], [], [], []
    runs = [chains(text) if text else [] for text in texts]
    lexicon.learn({w for found in runs for chain in found for w in chain})
    for i, text in enumerate(texts):
        for chain in runs[i]:
            numbers += lexicon.numbers(chain)
            lengths.append(len(chain))
            owner.append(i)
        letters.append(bool(text) and any(map(str.isalpha, text)))
    share, looks, count = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts)), np.zeros(len(texts))
    if numbers and model.languages:
        lengths, numbers, owner, potentials = np.array(lengths), np.array(numbers), np.array(owner), lexicon.table()
        for first, last, a, b in blocks(lengths, len(model.languages), CELLS):
            marginals, _, _ = forward_backward(potentials[numbers[a:b]], lengths[first:last], model.transitions)
            of = np.repeat(owner[first:last], lengths[first:last])
            for k in range(share.shape[1]):
                share[:, k] += np.bincount(of, marginals[:, k], len(texts))
            looks += np.bincount(of, lexicon.familiar[numbers[a:b], marginals.argmax(axis=1)], len(texts))
            count += np.bincount(of, minlength=len(texts))
    total = share.sum(axis=1)
    best = share.argmax(axis=1) if model.languages else np.zeros(len(texts), int)
    known = [has and n > 0 for has, n in zip(letters, total, strict=True)]
    scores = [float(min(1.0, share[i, b] / total[i])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best.tolist(), known, strict=True))]
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known, strict=True)], scores, (looks / np.maximum(count, 1)).tolist()


Chain = tuple[str | list[str], list[str]]


def joined(lines: list[Chain]) -> list[Chain]:
    """Chains of two or three pieces of lines of different languages, with each word's language.

    Lines are met in the order of their words' hashes, so the same lines give the same chains.
    """
    by_language: dict[str, list[list[str]]] = {}
    for lang, words in sorted(lines, key=lambda x: zlib.crc32(" ".join(x[1]).encode())):
        by_language.setdefault(lang, []).append(words)
    names, out = sorted(by_language), []
    if len(names) < 2:
        return []
    for i in range(len(lines) // JOINED):
        langs, words, used = [], [], ""
        for k in range(2 + i % 2):
            others = [x for x in (names[(i + k) % len(names)], names[(i // len(names) + 2 * k + 1) % len(names)]) if x != used]
            lang = used = others[0] if others else names[(names.index(used) + 1) % len(names)]
            line = by_language[lang][(i + k) % len(by_language[lang])]
            n = 1 + zlib.crc32(f"{i} {k}".encode()) % min(PIECE, len(line))
            start = zlib.crc32(f"{i} {k} start".encode()) % (len(line) - n + 1)
            langs += [lang] * n
            words += line[start : start + n]
        out.append((langs, words))
    return out


def train(lines: list[Chain], languages: list[str], rounds: int = 25, ridge: float = 1e-3) -> Model:
    """Fit on (language of all words, or of each word; words) chains."""
    model = Model(languages, np.zeros((SLOTS, len(languages)), np.float32), np.zeros((len(languages),) * 2))
    lines = [(lang, words) for lang, words in lines if words]
    place_of = {lang: i for i, lang in enumerate(languages)}
    of_language: list[set[str]] = [set() for _ in languages]
    for lang, words in lines:
        for x, w in zip([lang] * len(words) if isinstance(lang, str) else lang, words, strict=True):
            of_language[place_of[x]].add(w)
    met = [np.unique(np.fromiter((h for w in sorted(own) for part, tail in feature_parts(w) for h in part[len(part) - tail :]), np.uint32)) for own in of_language]
    model.grams = np.unique(np.concatenate([*met, np.zeros(0, np.uint32)]))
    model.bits = np.zeros((len(model.grams), -(-len(languages) // 8)), np.uint8)
    for k, own in enumerate(met):
        model.bits[np.searchsorted(model.grams, own), k // 8] |= np.uint8(128 >> k % 8)
    if not lines or len(languages) < 2:
        return model
    number: dict[str, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for _, words in lines for w in words), np.int64)
    lengths = np.array([len(words) for _, words in lines])
    y_all = np.fromiter((place_of[x] for lang, words in lines for x in ([lang] * len(words) if isinstance(lang, str) else lang)), np.int64)
    held, sizes = array("i"), []
    for w in number:
        sizes.append(0)
        for part, _ in feature_parts(w):
            held.extend(h % SLOTS for h in part)
            sizes[-1] += len(part)
    slots, sizes = np.frombuffer(held, np.int32), np.array(sizes)
    begin = np.cumsum(sizes) - sizes
    states, n = len(languages), len(at)
    inner = np.ones(n, bool)
    inner[np.cumsum(lengths) - lengths] = False  # a chain's first word follows none
    inner = np.flatnonzero(inner)
    seen_moves = np.zeros((states, states))
    np.add.at(seen_moves, (y_all[inner - 1], y_all[inner]), 1.0)
    weights, memory, g = np.zeros((SLOTS, states)), np.zeros((SLOTS, states)), np.zeros((SLOTS, states))
    memory_moves = np.zeros((states, states))
    parts = blocks(lengths, states, TRAIN_CELLS)
    for _ in range(rounds):  # each weight's step shrinks with the squares of its past gradients
        g[:], g_moves = 0, np.zeros((states, states))
        for first, last, a, b in parts:  # the gradient is a sum over chains
            words, place = np.unique(at[a:b], return_inverse=True)
            count = sizes[words]
            start = np.cumsum(count) - count
            used, of_slot = np.unique(slots[np.repeat(begin[words] - start, count) + np.arange(count.sum())], return_inverse=True)
            potentials = np.add.reduceat(weights[used][of_slot], start, axis=0)
            marginals, moves, _ = forward_backward(potentials[place], lengths[first:last], model.transitions)
            y = y_all[a:b]
            of = np.repeat(np.arange(len(words)), count)
            for k in range(states):
                surplus = np.bincount(place, (y == k) - marginals[:, k], len(words))
                g[used, k] += np.bincount(of_slot, surplus[of], len(used))
            g_moves -= moves
        g_moves = (seen_moves + g_moves) / n - ridge * model.transitions
        memory_moves += g_moves * g_moves
        for i in range(0, SLOTS, 1 << 12):  # in parts, which need no large arrays beside
            part = slice(i, i + (1 << 12))
            d = g[part] / n - ridge * weights[part]
            memory[part] += d * d
            weights[part] += 0.25 * d / np.sqrt(memory[part] + 1e-12)
        model.transitions = model.transitions + 0.25 * g_moves / np.sqrt(memory_moves + 1e-12)
    model.weights = weights.astype(np.float32)
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on documents with a language that are not held out, `sample` of each language.

    Every language is learned. Of each, the ids with the `sample` smallest hashes are taken (one
    document for each id), and of each document whole lines in the order of their hashes up to
    SAMPLE_WORDS words, so what comes to the driver is bounded for each language by itself.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("lang", F.xxhash64("doc_id", F.lit("sample")).alias("h"), "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    taken = usable.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= sample)
    bounds = taken.groupBy("lang").agg(F.max("h").alias("most")).collect()
    if not bounds:
        return Model()
    bound = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["most"]) for r in bounds], "lang string, most long"))
    chosen = usable.join(bound, "lang").where(F.col("h") <= F.col("most")).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def run(batches):
        for b in slices(batches):
            langs, words = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = 0
                for chain in sorted(chains(text), key=lambda c: zlib.crc32(" ".join(c).encode())):
                    if held + len(chain) <= SAMPLE_WORDS:
                        held += len(chain)
                        langs.append(lang)
                        words.append(" ".join(chain))
            yield pa.RecordBatch.from_pydict({"lang": langs, "words": words}, schema=pa.schema([("lang", pa.string()), ("words", pa.string())]))

    rows = chosen.select("lang", "text").mapInArrow(run, "lang string, words string").toArrow()
    once: dict[str, str] = {}  # words that occur often are held once
    lines = sorted((lang, [once.setdefault(w, w) for w in words.split(" ")]) for b in rows.to_batches() for lang, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    del rows
    return train(lines + joined(lines), sorted(r["lang"] for r in bounds))


def tag_words(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id and words, an array of (start, end, lang, probability) in text order.

    Places are code points of the lower-cased text. A null text, one without letters, or a model
    without languages gives an empty array; a null doc_id stays null; repeated rows each keep
    their row; an empty table gives no rows; other columns are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("probability", pa.float64())]))

    def run(batches):
        lexicon = Lexicon(model)
        for b in slices(batches):
            lexicon.trim()
            out = []
            for text in b.column(1).to_pylist():
                runs = chains(text) if text and model.languages else []
                found = []
                if runs:
                    numbers = np.array([i for run in runs for i in lexicon.numbers(run)])
                    marginals, _, _ = forward_backward(lexicon.table()[numbers], np.array([*map(len, runs)]), model.transitions)
                    marginals /= marginals.sum(axis=1, keepdims=True)
                    best = marginals.argmax(axis=1)
                    for m, row, k in zip(_WORD.finditer(text.lower()), marginals, best.tolist(), strict=True):
                        found.append({"start": m.start(), "end": m.end(), "lang": model.languages[k], "probability": float(row[k])})
                out.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words array<struct<start:int,end:int,lang:string,probability:double>>")


def in_known_language(docs: DataFrame, model: Model, least: float = 0.4, known: float = 0.6) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text has a language with a share of at least `least`.

    Texts without letters go, null and empty ones among them, and those of which no language has
    that share of the words. Shares are among learned languages only, so texts of which less than
    `known` of the words look like words of the language that they are taken for (other languages,
    random letters) go as well; a word is held against that one language only, so more languages
    do not make more words familiar. A model without languages keeps nothing. Nulls in other columns do not matter; each
    of repeated rows stays or goes as the others do; an empty table gives no rows; further columns,
    also such as score or lang_pred, go through as they are.
    """

    def run(batches):
        lexicon = Lexicon(model)
        for b in slices(batches):
            lexicon.trim()
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            langs, scores, looks = predict(texts, model, lexicon)
            yield b.filter(pa.array([lang != UNKNOWN and s >= least and f >= known for lang, s, f in zip(langs, scores, looks, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, lang_pred (a learned language, or `und`) and score (0 to 1).

    One pass without a shuffle. A null text, one without letters, or a model without languages
    gives `und` with score 0. Of languages with equal shares the first in the order of their names
    is taken. A null doc_id stays null; repeated rows each keep their row; an empty table gives no
    rows; other columns are not read. All words count, however long the text or a word of it.
    """

    def run(batches):
        lexicon = Lexicon(model)
        for b in slices(batches):
            lexicon.trim()
            langs, scores, _ = predict(b.column(1).to_pylist(), model, lexicon)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
