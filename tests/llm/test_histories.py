"""The models of words after words against a plain version, place by place, and against marks that were held out."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.llm import histories, toxicity
from skillgrid.llm.queries import QUERIES
from skillgrid.session import CLEANUP, materialize
from test_toxicity import SF, ranked, words


def discount(counts):
    n = Counter(counts)
    return min(0.95, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5


class Plain:
    """Interpolated Kneser-Ney models of both classes, from dictionaries."""

    def __init__(self, labelled):
        self.pairs = [Counter(), Counter()]
        for seq, y in labelled:
            self.pairs[y].update(zip([None, *seq], seq))
        self.before, self.after, self.places = ([Counter(), Counter()] for _ in range(3))
        for y in (0, 1):
            for (v, w), n in self.pairs[y].items():
                self.before[y][w] += 1
                self.after[y][v] += 1
                self.places[y][v] += n
        self.total, self.kinds = [sum(c.values()) for c in self.before], [len(c) for c in self.before]
        self.shared = sum(self.total) + len(set(self.before[0]) | set(self.before[1])) + 1
        self.d1, self.d2 = [discount(c.values()) for c in self.before], [discount(c.values()) for c in self.pairs]

    def features(self, seq, own=None):
        if not seq:
            return 0.0, 0.0
        pairs = [Counter(self.pairs[y]) if y == own else self.pairs[y] for y in (0, 1)]
        tables = [(self.before[y], self.after[y], self.places[y]) for y in (0, 1)]
        if own is not None:
            tables[own] = before, after, places = [Counter(c) for c in tables[own]]
            for (v, w), n in Counter(zip([None, *seq], seq)).items():
                pairs[own][v, w] -= n
                places[v] -= n
                if not pairs[own][v, w]:
                    before[w] -= 1
                    after[v] -= 1

        def word(w):
            n = [tables[y][0][w] for y in (0, 1)]
            return [max(n[y] - self.d1[y], 0) / self.total[y] + self.d1[y] * self.kinds[y] / self.total[y] * (sum(n) + 1) / self.shared for y in (0, 1)]

        ratios = []
        for v, w in zip([None, *seq], seq):
            p = word(w)
            for y in (0, 1):
                _, after, places = tables[y]
                if places[v]:
                    p[y] = max(pairs[y][v, w] - self.d2[y], 0) / places[v] + self.d2[y] * after[v] / places[v] * p[y]
            ratios.append(math.log(p[1] / p[0]))
        return sum(ratios) / len(ratios), max(math.log(word(w)[1] / word(w)[0]) for w in set(seq))


def plain_version(rows, marks):
    labelled = [(words(t), marks[i]) for i, t in rows if i in marks and zlib.crc32(str(i).encode()) % 5]
    model = Plain(labelled)
    return model, [(i, *model.features(words(t))) for i, t in rows], labelled


def test_order_of_words_counts(spark):
    """Both classes have the same words in documents and as often, after other words: only what stands before them tells."""
    texts = [("du bist nett und klug" if i % 2 else "klug bist nett und du", i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(100, "bist du nett"), (101, "bist nett und klug")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    got = {r.doc_id: r.mean for r in histories.score(docs, histories.fit(docs, labels)).collect()}
    assert got[101] > got[100] and got[1] > 0.1 > -0.1 > got[0]


def test_pair_keys_are_those_of_spark(spark):
    x = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, (50, 2))
    rows = spark.createDataFrame(x.tolist(), "v long, w long").select("v", "w", F.xxhash64("v", "w").alias("k")).collect()
    v, w, k = (np.array([r[c] for r in rows], np.int64) for c in "vwk")
    assert (histories.pair_key(v.view(np.uint64), w.view(np.uint64)).view(np.int64) == k).all()


@pytest.mark.parametrize(("share", "passes", "slice_bytes"), [(1e-6, 4, 6_000_000), (0.003, 1, 300), (2.0, 2, 1000)])
def test_scores_equal_a_plain_version(spark, docs, share, passes, slice_bytes):
    """Odd rows beside enough others; what is frequent, the passes and the slices decide nothing."""
    rng = np.random.default_rng(3)
    more = [(i, " ".join([f"u{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 40)) if x < 500] + ["awful"] * int(i % 4 == 0 and i % 3)), "en", "a", 1) for i in range(20, 160)]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    rows = rows.union(rows.where("doc_id = 30")).withColumn("toxic", F.lit("x")).withColumn("t", F.lit(1)).withColumn("w", F.lit(1)).withColumn("uid", F.lit(1))
    rows = rows.union(rows.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    marks = [(i, None, int(i % 4 == 0)) for i in range(0, 160) if i % 7] + [(21, None, None), (None, None, 1), (22, None, 0), (999, None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y"))
    fitted = histories.fit(rows, labels, share=share, passes=passes, slice_bytes=slice_bytes)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.mean, r.top, r.score) for r in histories.score(rows, fitted, slice_bytes=slice_bytes).collect())
    plain = [(r.doc_id if r.doc_id is not None else -1, r.text) for r in rows.select("doc_id", "text").collect()]
    model, want, labelled = plain_version(plain, {i: y for i, _, y in marks if i is not None and y is not None})
    assert [x[0] for x in got] == [x[0] for x in sorted(want)]
    assert np.allclose([x[1:3] for x in got], [x[1:] for x in sorted(want)], atol=1e-9)
    m = fitted.model
    assert (m.total, m.words, m.shared) == (model.total, model.kinds, model.shared) and np.allclose(m.discount + m.pair_discount, model.d1 + model.d2)
    # of the fit, each document without itself; the row that is there twice counts once
    x = np.array(sorted(([*model.features(seq, y), y] for seq, y in dict.fromkeys((tuple(s), y) for s, y in labelled)), key=lambda r: r[::-1]))
    assert len(x) > 60
    a, b, c = m.logistic
    assert np.allclose([x[3] for x in got], [1 / (1 + math.exp(-(a + b * mean + c * top))) for _, mean, top, _ in got])


def test_without_marks_of_both_kinds(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for marks, share in ((labels, 0.0), (spark.createDataFrame([(0, 1), (1, 1), (5, None)], "doc_id long, toxic int"), 1.0)):
        got = histories.score(docs, histories.fit(docs, marks)).collect()
        assert len(got) == docs.count() and {r.score for r in got} == {share}
    assert histories.score(none, histories.fit(none, labels)).count() == 0


def test_op13_is_the_models_of_pairs(spark, monkeypatch):
    """Equal to the plain version on every document, by a logistic function over what labelled ones say without themselves; labels beyond the broadcast make no difference."""
    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    marks = dict(con.execute(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    got = {r.doc_id: r for r in QUERIES["op13_toxicity"](spark, SF).collect()}
    assert sorted(got) == sorted(i for i, _ in rows)
    model, want, labelled = plain_version(rows, marks)
    x = np.array([[*model.features(seq, y), y] for seq, y in labelled])
    a, b, c = toxicity.logistic(x[:, :2], x[:, 2])
    for i, mean, top in want:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert abs(got[i].score - 1 / (1 + math.exp(-(a + b * mean + c * top)))) < 1e-6
        assert got[i].predicted == int(got[i].score >= 0.5)
    held = [i for i in marks if got[i].held_out]
    assert np.mean([got[i].predicted == marks[i] for i in held]) > 0.93
    assert ranked(np.array([got[i].score for i in held]), np.array([marks[i] for i in held])) > 0.8


def test_texts_are_read_once_a_pass(spark, docs):
    """The counts of pairs are kept: labelled texts aren't counted again where texts are scored."""
    n, read = docs.count(), spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = docs.select("doc_id", "text")
    labels = rows.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    got = histories.score(seen := rows.mapInArrow(run, rows.schema), histories.fit(seen, labels))
    assert got.count() == n and read.value <= 7 * n


def test_bits_miss_no_key(spark):
    """Every key's bit is set, whatever its sign, and few others."""
    x = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, (2, 5000))
    bits = histories.bits_of(spark.createDataFrame(x[0][:, None].tolist(), "k long"), x.shape[1])
    assert histories.may_have(bits, x[0].view(np.uint64)).all() and histories.may_have(bits, x[1].view(np.uint64)).mean() < 0.15


def test_parts_are_those_of_spark(spark):
    """On arrays and on columns a hash is of the same part, and columns that were packed are the same again."""
    x = np.sort(np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 300))
    for parts in (1, 2, 3, 7):
        got = [r.p for r in spark.createDataFrame(x[:, None].tolist(), "k long").select(histories.part_column(F.col("k"), parts).alias("p")).collect()]
        assert got == histories.part_of(x.view(np.uint64), parts).tolist() and set(got) == set(range(parts))
    for some in (x, x[:0]):
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(histories.unpacked(histories.packed((some, some / 3))), (some, some / 3)))


def test_known_hashes_are_found():
    """Every one at its place and no other, of many, few and none, also where they stand close together."""
    x = np.unique(np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 3000))
    for some in (x, x[:1], x[:0], np.unique(np.concatenate([x[:5], np.arange(-40, 40)])), np.array([-(2**63), 0, 2**63 - 1])):
        asked = np.concatenate([some, x[::-1], some + 1, np.arange(-50, 50), [-(2**63), 2**63 - 1]]).astype(np.int64)
        there, at = histories.Known(some).find(asked)
        assert there.tolist() == np.isin(asked, some).tolist()
        assert (some[at[there]] == asked[there]).all()


def test_frequent_ones_are_bounded(spark):
    rows = spark.createDataFrame([(n,) for n in [1] * 50 + [2] * 20 + [3] * 5 + [40]], "n long")
    for share, least in ((1.0, 40), (1 / 6, 3), (1 / 25, 3), (1 / 26, 2), (1 / 76, 1)):
        assert histories.most_frequent(rows, F.col("n"), share, 145) == least
    assert histories.most_frequent(rows.where("n < 0"), F.col("n"), 0.5, 0) == 1


def test_cleanup_leaves_the_setting(spark):
    """The setting that deletes shuffle files holds for the write alone."""
    before = spark.conf.get(CLEANUP, None)
    assert materialize(spark.range(100).groupBy(F.col("id") % 3).count(), "three", cleanup=True).count() == 3
    assert spark.conf.get(CLEANUP, None) == before
