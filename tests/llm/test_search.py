"""Lexical search and hard negatives on odd rows, against plain versions of themselves."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.llm import lexical, negatives

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    """Every document's whole score for every item."""
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got_search(found):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in found.collect()), key=str)


ITEMS = [(1, "The CAT sat on the moon, the moon"), (2, None), (3, ""), (4, "été ÉTÉ ΣΑΣ 日本"), (5, "w1 w2 w3 nowhere one"), (5, "w1 w2 w3 nowhere one"), (None, "one x"), (7, "?!")]


@pytest.mark.parametrize("sizes", [{}, {"shard_docs": 2}, {"shard_postings": 3}, {"block_bytes": 40}])
def test_search(spark, docs, sizes):
    """Nulls, repeated rows and items, ties, long texts, clashing columns; the same whatever the shards and blocks."""
    docs = docs.unionByName(docs.where("doc_id in (0, 8)").withColumn("doc_id", F.lit(None).cast("long")))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit(0)).withColumn("score", F.lit("x"))
    want = plain_search([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [x for x in ITEMS if x[1] is not None], 3)
    assert got_search(lexical.search(docs, items, 3, **sizes)) == want and len(want) > 9


@pytest.mark.parametrize("seed", range(3))
def test_search_stops_making_accumulators_without_a_change(spark, seed, monkeypatch):
    """Skewed terms, short shards: most documents never get an accumulator, and the result is whole."""
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join(f"t{int(x)}" for x in np.minimum(rng.zipf(1.3, n), 400))
    rows = [(i, word(rng.integers(1, 60))) for i in range(400)]
    asked = [(i, word(rng.integers(1, 30))) for i in range(12)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    assert got_search(lexical.search(docs, items, 4, shard_docs=150)) == plain_search(rows, asked, 4)


def test_search_of_nothing(spark, none):
    items = spark.createDataFrame([(1, "x")], "item_id long, text string")
    found = lexical.search(none, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0
    assert lexical.search(items.withColumnRenamed("item_id", "doc_id"), items.where("false")).count() == 0


# ---- hard negatives ----------------------------------------------------------------------------


@pytest.mark.parametrize("largest", [1, 100, 20_000, 3_000_000])
@pytest.mark.parametrize("width", [0, 1, 64, 2200])
def test_residues_give_exact_products(largest, width):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-largest, largest + 1, (7, width)), rng.integers(-largest, largest + 1, (9, width))
    if width:
        a[0], b[0], b[1] = largest, largest, -largest
    bound = max(1, largest**2 * width)
    if bound >= negatives.TOO_LARGE:
        bound, a, b = negatives.TOO_LARGE - 1, a[:, :50], b[:, :50]
    system = negatives.Residues(bound)
    assert (system.times(system.of(a), system.of(b)) == a @ b.T).all()


def plain_mining(rows, anchor, k=5):
    kept = [(i, n, [math.floor(256 * x) for x in v]) for i, n, v in rows if i is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in kept:
        if not anchor(i):
            continue
        scored = sorted((-dot(v, w), j, n == label) for j, n, w in kept if j != i)
        for s, j, _ in [x for x in scored if x[2]][:k]:
            fit = [(-t, q) for t, q, alike in scored if not alike and -80 * s <= -100 * t <= -100 * s][:k]
            out += [(i, j, r, q, -s, t) for r, (t, q) in enumerate(fit, 1)]
    return sorted(out)


ODD = [(100, 1, None), (101, None, [0.5, 0.5]), (None, 1, [0.5, 0.5]), (102, 1, [0.5, None]), (103, 1, [float("nan"), 0.5]), (104, 2, [float("inf"), 0.5]), (105, 1, []), (106, 2, []), (107, 1, [0.9])]


@pytest.mark.parametrize("group_bytes", [1 << 20, 300])
def test_mining(spark, group_bytes):
    """Nulls, non-finite components, short vectors, ties, repeated rows and anchors, negative scores, clashing columns; any groups of anchors."""
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(size=4).round(1).tolist()) for i in range(90)] + ODD
    rows += [rows[3], rows[10], rows[10], (200, 0, [-0.5, -0.5, -0.5, -0.5]), *((300 + i, i % 2, [0.25, 0.5, 0.0, 0.0]) for i in range(12))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for clash in ("score", "anchor", "positive", "norm2", "vector", "group", "rank"):
        df = df.withColumn(clash, F.lit("x"))
    found = negatives.mine(df, F.col("vec_id") % 10 == 0, group_bytes=group_bytes)
    got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found.collect())
    assert got == plain_mining(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_mining_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(empty, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(alone, F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(Exception, match="too large"):
        negatives.mine(spark.createDataFrame([(0, 1, [1e30])], "vec_id long, label int, embedding array<float>"), F.col("vec_id") == 0)
