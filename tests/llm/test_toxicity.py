"""Toxicity against a plain version of the two models, and against marks that were held out."""

import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skillgrid.llm import toxicity
from skillgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bit_before(seq, i):
    h = xxhash.xxh3_64_intdigest(seq[i - 1].encode()) if i else 0
    return 1 << (h * 0x9E3779B97F4A7C15 % 2**64 >> 58)


def plain_scores(rows, marks):
    """(mean, top) of every row by the counts of the labelled ones, word by word; and the features of these without themselves."""
    docs, bits = [{}, {}], [{}, {}]
    labelled = [(i, words(t), marks[i]) for i, t in rows if i in marks and zlib.crc32(str(i).encode()) % 5]
    for _, seq, y in labelled:
        for w in set(seq):
            docs[y][w] = docs[y].get(w, 0) + 1
        for k, w in enumerate(seq):
            bits[y][w] = bits[y].get(w, 0) | bit_before(seq, k)

    def count(w, y, less=0):
        unset = 64 - bits[y].get(w, 0).bit_count()
        return min(docs[y].get(w, 0) - less, math.floor(-64 * math.log(unset / 64) + 0.5) if unset else 10**9)

    every = set(docs[0]) | set(docs[1])
    counts = [[count(w, y) for w in every] for y in (0, 1)]
    total, kinds = [sum(c) for c in counts], [sum(x > 0 for x in c) for c in counts]
    d = [min(0.95, max(0.1, c.count(1) / (c.count(1) + 2 * c.count(2)))) if c.count(1) else 0.5 for c in counts]
    if not all(total):
        return None, None

    def features(seq, own=None):
        ratios = []
        for w in set(seq):
            c = [count(w, y, own == y) for y in (0, 1)]
            shared = (sum(c) + 1) / (sum(total) + len(every) + 1)
            p = [max(c[y] - d[y], 0) / total[y] + d[y] * kinds[y] / total[y] * shared for y in (0, 1)]
            ratios.append(math.log(p[1] / p[0]))
        return (sum(ratios) / len(ratios), max(ratios)) if ratios else (0.0, 0.0)

    return [(i, *features(words(t))) for i, t in rows], [(*features(seq, y), y) for _, seq, y in labelled]


@pytest.mark.parametrize("share", [1e-6, 0.01, 2.0])
def test_scores_equal_a_plain_version(spark, docs, share, monkeypatch):
    """Odd rows beside enough others, with all words frequent, some, and none: the split decides nothing."""
    rng = np.random.default_rng(3)
    more = [(i, " ".join([f"u{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 40)) if x < 500] + ["awful"] * int(i % 4 == 0 and i % 3)), "en", "a", 1) for i in range(20, 160)]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    rows = rows.union(rows.where("doc_id = 30")).withColumn("toxic", F.lit("x")).withColumn("total", F.lit(1)).withColumn("w", F.lit(1)).withColumn("uid", F.lit(1))
    rows = rows.union(rows.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    marks = [(i, None, int(i % 4 == 0)) for i in range(0, 160) if i % 7] + [(21, None, None), (None, None, 1), (22, None, 0), (999, None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y"))
    fitted = toxicity.fit(rows, labels, share=share)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.mean, r.top, r.score) for r in toxicity.score(rows, fitted).collect()))
    known = {i: y for i, _, y in marks if i is not None and y is not None}
    plain = [(r.doc_id if r.doc_id is not None else -1, r.text) for r in rows.select("doc_id", "text").collect()]
    want, learned = plain_scores(plain, known)
    assert [x[0] for x in got] == [x[0] for x in sorted(want)]
    assert np.allclose([x[1:3] for x in got], [x[1:] for x in sorted(want)], atol=1e-9)
    # the fit is a function of what labelled documents say without themselves; a repeated row of one id counts once in it
    a, b, c = fitted.model.logistic
    assert np.allclose([x[3] for x in got], [1 / (1 + math.exp(-(a + b * m + c * t))) for _, m, t, _ in got])
    assert all(0 <= x[3] <= 1 for x in got) and len(learned) > 60


def test_without_marks_of_both_kinds(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for marks, share in ((labels, 0.0), (spark.createDataFrame([(0, 1), (1, 1), (5, None)], "doc_id long, toxic int"), 1.0)):
        got = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
        assert len(got) == docs.count() and {r.score for r in got} == {share}
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    other = toxicity.fit(docs, labels)
    assert one.model.total == other.model.total and np.allclose(one.model.logistic, other.model.logistic)


def test_op13_over_the_whole_table(spark):
    """Equal to the plain version on every document; held-out marks are met."""
    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    marks = dict(con.execute(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    got = {r.doc_id: r for r in QUERIES["op13_toxicity"](spark, SF).collect()}
    assert sorted(got) == sorted(i for i, _ in rows)
    want, learned = plain_scores(rows, marks)
    x = np.array(sorted(learned, key=lambda r: r[::-1]))
    a, b, c = toxicity.logistic(x[:, :2], x[:, 2])
    for i, mean, top in want:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert abs(got[i].score - 1 / (1 + math.exp(-(a + b * mean + c * top)))) < 1e-6
        assert got[i].predicted == int(got[i].score >= 0.5)
    judged = [got[i].predicted == y for i, y in marks.items() if got[i].held_out]
    assert np.mean(judged) > 0.93


def ranked(scores, marks):
    """The share of pairs of a marked and an unmarked row in which the marked one has the higher score, ties as half."""
    one, other = scores[marks == 1][:, None], scores[marks == 0][None, :]
    return float((one > other).mean() + (one == other).mean() / 2)


def test_few_marks_dont_turn_the_ranking(spark):
    """Of the marks among 200 documents no weight is negative, and held-out rows rank the right way."""
    big = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    held = docs.where(toxicity.held_out(F.col("doc_id"))).join(labels.where("toxic is not null").select("doc_id", F.col("toxic").alias("mark")), "doc_id")
    for first, least in ((900, 0.74), (2700, 0.5)):
        fitted = toxicity.fit(docs, labels.where(F.col("doc_id").between(first, first + 199)))
        assert min(fitted.model.logistic[1:]) >= 0 < max(fitted.model.logistic[1:])
        rows = toxicity.score(held, fitted).join(held.select("doc_id", "mark"), "doc_id").toArrow()
        assert ranked(rows["score"].to_numpy(), rows["mark"].to_numpy()) > least


def test_no_weight_is_negative():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.3).astype(float)
    x = np.column_stack([y + rng.normal(size=400), -y + rng.normal(size=400)])
    a, b, c = toxicity.logistic(x, y)
    assert b > 0 and c == 0.0
    assert toxicity.logistic(-x[:, :1] * [1, 1], y)[1:] == [0.0, 0.0]
