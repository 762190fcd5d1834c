"""The cleaning functions against plain patterns, on every mixture of awkward characters, and on long words."""

import random
import time

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.settings import EXOTIC_SPACES, FOOTERS, LINE_BREAK, LINE_BREAK_CHARACTERS

SPACE = r"[\s\x1c-\x1f\x85]"
BITS = [*"ab9_-\u00e9\u2014 \t\n\r\x0b\x0c\x1c\x1e\x1f\x85\xa0\u1680\u180e\u2007\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\U00020000", "-\n", "-\nb", "page 1 of 2", "DRAFT", "- 7 -", "12", "\r\n", "\n\n", " \n"]


def plain_strip(c):
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def plain_lines(c):
    return F.regexp_extract_all(c, F.lit(rf"([^{LINE_BREAK_CHARACTERS}]++)(?:{LINE_BREAK}|\z)|(?:{LINE_BREAK})"), F.lit(1))


def plain_spaces(c):
    c = F.regexp_replace(F.regexp_replace(c, rf"(?U)(?<=\w){EXOTIC_SPACES}(?=\w)", ""), EXOTIC_SPACES, " ")
    for pattern, written in ((r"[ \t]+", " "), (r" +\n", "\n"), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, written)
    return plain_strip(c)


def plain_footers(c):
    kept = lambda x: ~(F.rlike(x, F.lit(FOOTERS[0])) | F.rlike(x, F.lit(FOOTERS[1])) | F.rlike(x, F.lit(FOOTERS[2])) | F.rlike(x, F.lit(FOOTERS[3])) | F.rlike(x, F.lit(FOOTERS[4])))
    return F.array_join(F.filter(plain_lines(c), kept), "\n")


def test_same_as_plain_patterns(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices(BITS, k=draw.randrange(12))) for _ in range(6000)] + [None, ""]
    # a table behind a shuffle, so that nothing is worked out while planning
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    t = F.col("t")
    pairs = [
        (T.strip(t), plain_strip(t)), (T.lines(t), plain_lines(t)), (T.collapse_whitespace(t), plain_spaces(t)), (T.without_footers(t), plain_footers(t)),
        (T.join_hyphenated(t), F.regexp_replace(t, r"(?U)(\w+)-\n([a-z])", "$1$2")), (T.line_key(t), F.regexp_replace(plain_strip(t), rf"(?U){SPACE}+", " ")),
    ]
    for i, (got, want) in enumerate(pairs):
        wrong = rows.select(t, got.alias("got"), want.alias("want")).where(~F.col("got").eqNullSafe(F.col("want"))).head(3)
        assert not wrong, (i, wrong)


def test_long_words_and_blanks_take_linear_time(spark):
    """A word without a hyphen, and blanks inside a text, were gone through once from each of their characters."""
    rows = spark.range(1).select(F.concat(F.repeat(F.lit("a"), 60_000 + F.col("id").cast("int")), F.repeat(F.lit(" "), 60_000), F.lit("b")).alias("t"))
    began = time.time()
    assert rows.select(F.length(T.collapse_whitespace(T.join_hyphenated(F.col("t"))))).head()[0] == 60_002
    assert time.time() - began < 5
