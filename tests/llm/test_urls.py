"""URL filters: rules against a plain reading of them, trees against numpy and held-out URLs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import urls
from quillstone.llm.queries import URL_RULES

ODD = [
    None, "", "no scheme", "http://", "http://ORG/", "http://org", "http://org?x=/", "http://a.Example.ORG/es/1", "http://example.org/en/1",
    "http://example.org/en/2", "http://badexample.org/es/", "https://x.com/fr/", "https://x.com/de/9#t", "ftp://com/de", "http://a/b://c/d",
    "http://u@com:80/fr/", "://org/x\ny/z?q", "http://ÄORG.org/É/1", "http://org/" + "9" * 5000,
]


def plain(url):
    """Host, path and rule as the contract words them."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return host, path, rule


@pytest.fixture(scope="module")
def pages(spark):
    rng = np.random.default_rng(0)
    made = [f"http://{rng.choice(['a', 'b.c', 'example'])}.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.integers(9999)}{rng.choice(['', '.html', '/'])}" for _ in range(1500)]
    return spark.createDataFrame([(i if i != 2 else None, u, "x") for i, u in enumerate([*ODD, *made, *made[:3]])], "page_id long, url string, host string")


def test_rules(pages):
    rows = {(r.page_id, r.url) for r in pages.collect()}
    got = urls.judge(pages, URL_RULES).collect()
    assert len(got) == pages.count()
    by_id = {r.page_id: r for r in got}
    for page_id, url in rows:
        host, path, rule = plain(url)
        r = by_id[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.host + rule.path), url
        assert r.verdict == (rule.verdict if rule else "block" if r.score > 0.5 else "allow")


def described(model, df):
    """`df` with suffix rates, and all features as columns."""
    url = F.col("url")
    host, path = urls.host_and_path(url)
    parts = urls.suffixes(host, path)
    return model.with_rates(df, parts), {**urls.lexical(url, host, path), **{f"{k}_rate": F.col(f"f_{k}_rate") for k in parts}}


def test_every_suffix_has_its_rate(spark):
    """Two hundred sections, half of them blocked: each is known, and unseen ones get the prior."""
    rows = [(f"http://x.net/s{i}/p{j}", i % 2) for i in range(200) for j in range(6)]
    model = urls.fit(spark.createDataFrame(rows, "url string, block int"))
    assert set(model.rates["section"]) == {f"s{i}" for i in range(200)}
    fresh = spark.createDataFrame([(f"http://x.net/s{i}/fresh", i % 2) for i in range(200)] + [("http://x.net/other/1", 0)], "url string, block int")
    got, features = described(model, fresh)
    rows = got.select("url", "block", "f_section_rate", (model.score(features) > 0.5).cast("int").alias("said")).collect()
    assert len(rows) == 201 and all(r.said == r.block for r in rows if "/s" in r.url)
    assert all((r.f_section_rate > 0) == bool(r.block) for r in rows if "/s" in r.url)
    assert [r.f_section_rate for r in rows if "other" in r.url] == [model.prior]


def test_trees_inside_spark_equal_numpy(spark, pages):
    labelled = pages.where("url is not null").select("url", (F.xxhash64("url") % 3 == 0).cast("int").alias("block"))
    model = urls.fit(labelled)
    got, features = described(model, labelled)
    got = got.select(*[c.alias(n) for n, c in features.items()], model.score(features).alias("score")).toPandas()
    x = got[list(features)].to_numpy(float)
    want = 1 / (1 + np.exp(-(model.base + sum(urls.evaluate(t, x, list(features)) for t in model.trees))))
    assert model.trees and np.allclose(got["score"], want)


def test_held_out_accuracy(spark, pages):
    """Trees fitted on one half of the URLs that rules label tell the other half apart."""
    rows = [(r.url, int(plain(r.url)[2].verdict == "block")) for r in pages.collect() if plain(r.url)[2]]
    half = lambda k: spark.createDataFrame(rows[k::2], "url string, block int")
    model = urls.fit(half(0))
    rest, features = described(model, half(1))
    right = rest.select(((model.score(features) > 0.5).cast("int") == F.col("block")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.9


def test_copies_of_one_url_do_not_fill_the_sample(spark, pages):
    labelled = pages.where("url is not null").select("url", (F.xxhash64("url") % 3 == 0).cast("int").alias("block"))
    first = labelled.orderBy(F.xxhash64("url"), "url").limit(1)
    more = labelled.unionByName(first.crossJoin(spark.range(400)).drop("id"))
    a, b = urls.fit(labelled, sample=300), urls.fit(more, sample=300)
    assert b.trees and (a.base, a.trees, a.rates) == (b.base, b.trees, b.rates)


def test_empty_table_and_no_labels(spark, pages):
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0
    rows = urls.judge(pages.where("page_id = 3"), URL_RULES).collect()
    assert [(r.verdict, r.score) for r in rows] == [("allow", 0.5)]
