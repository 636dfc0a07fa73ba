"""Toxicity by class-conditional Kneser-Ney models.

The labelled documents make one word model for toxic and one for ordinary text. As in Kneser-Ney smoothing, a word counts by the number of different contexts it was
seen in, not by how often: documents of the class that hold it, or different words before it in that class, whichever are fewer. So neither a word that one document
repeats nor copies of a document weigh much. Of each count an absolute discount is taken (n1 / (n1 + 2 n2), by class), and what is discounted goes by the shared
backoff counts, which are the two classes' together, so that rare and unseen words are smoothed alike in both:

    P_class(w) = max(c_class(w) - D, 0) / N_class + D V_class / N_class * (c(w) + 1) / (N + V + 1)

A document is compared by its log-likelihoods under both, over its different words: normalised by their number, and at its most telling word. A logistic function of the two
makes the score; it is fitted on at most about ``SAMPLE`` labelled documents, each compared as if it hadn't been counted itself. Everything else covers all rows.

How it runs: tasks count words by a 64-bit hash and the tables are summed by word. A word that is a millionth of all counts or more is frequent; there are at most a million of these (24 MB), which are
broadcast. A document's frequent words are compared where its text is read; only its rare words move, one small row for each, to be joined with the counts and summed by document.
Different words before a word are estimated from 64 bits, which add up by OR; where all are set, documents alone count.
Labels (an id and a mark) are broadcast up to ``BROADCAST_LABELS`` rows, counted first; beyond that they are joined by a shuffle of the texts that may be learned from.

Defined results: a null or empty text has no words and the score of that; a document with several marks is toxic if one says so, null marks say nothing; a null id has no label and isn't held out; without
labelled rows of both classes all scores are the share of toxic ones, 0 without any; repeated rows stay; very long texts are read whole; an empty table gives an empty one; other
columns, whatever their names, are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.bpe import runs_of
from skillgrid.llm.decontaminate import fold
from skillgrid.llm.ragged import offsets_of, slices
from skillgrid.llm.substrings import word_hashes
from skillgrid.session import drop, materialize

#: The share of all counts that makes a word frequent, labelled documents of the fit, labels that are broadcast at most.
SHARE, SAMPLE, BROADCAST_LABELS = 1e-6, 20_000, 1_000_000
#: A count of contexts that documents alone decide.
MANY = (1 << 31) - 1


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """What both classes' probabilities need, and the logistic function over the two comparisons."""

    total: list[int]
    words: list[int]
    discount: list[float]
    shared: int  # all counts, all words and one
    share: float  # of toxic documents
    logistic: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])

    def log_ratio(self, ordinary, toxic, most, log):
        """Log of the toxic over the ordinary probability of a word with these counts; on arrays and on columns, with their ``most`` and ``log``."""
        backoff = (ordinary + toxic + 1.0) / self.shared
        p = [most(c - d, 0.0) / n + d * v / n * backoff for c, n, v, d in zip((ordinary, toxic), self.total, self.words, self.discount)]
        return log(p[1] / p[0])

    def score(self, mean: Column, top: Column) -> Column:
        if not all(self.total):
            return F.lit(self.share)
        a, b, c = self.logistic
        return 1 / (1 + F.exp(-(F.lit(a) + b * mean + c * top)))


def words_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text, a bit for the word before every word)."""
    words, off = runs_of(fold(part.column(part.schema.get_field_index("text"))))
    h = word_hashes(words)
    before = np.zeros(len(h), np.uint64)
    before[1:] = h[:-1]
    starts = off[:-1][np.diff(off) > 0]
    before[starts] = 0
    return h, off, np.uint64(1) << ((before * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))


def distinct_words(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's different words: the text's number and the hash."""
    of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    return of[new], h[new]


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def word_counts(labelled: DataFrame, slice_bytes: int) -> DataFrame:
    """(w, d0, d1, c0, c1): of every word's hash, documents and different words before it, by class. ``labelled``: (text, toxic)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                h, off, bit = words_of(part)
                toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                names, code = np.unique(h, return_inverse=True)
                of, own = distinct_words(h, off)
                docs = np.bincount(np.searchsorted(names, own) * 2 + toxic[of], minlength=2 * len(names)).reshape(-1, 2)
                bits = np.zeros((len(names), 2), np.uint64)
                np.bitwise_or.at(bits.reshape(-1), code * 2 + np.repeat(toxic, np.diff(off)), bit)
                yield pa.RecordBatch.from_arrays([signed(names), pa.array(docs[:, 0]), pa.array(docs[:, 1]), signed(np.ascontiguousarray(bits[:, 0])), signed(np.ascontiguousarray(bits[:, 1]))], ["w", "d0", "d1", "b0", "b1"])

    found = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "w long, d0 long, d1 long, b0 long, b1 long")
    summed = found.groupBy("w").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"), F.bit_or("b0").alias("b0"), F.bit_or("b1").alias("b1"))
    unset = lambda b: 64 - F.bit_count(b)
    contexts = lambda b: F.when(unset(b) == 0, MANY).otherwise(F.round(-64 * F.log(unset(b) / 64.0))).cast("int")
    return summed.select("w", F.col("d0").cast("int").alias("d0"), F.col("d1").cast("int").alias("d1"), contexts("b0").alias("c0"), contexts("b1").alias("c1"))


def compared(docs: DataFrame, counts: DataFrame, frequent: pa.Table, model: Model, slice_bytes: int) -> DataFrame:
    """(doc_id, toxic, mean, top) of every row of (doc_id, text, toxic): log-ratios over its different words, their mean and their largest.

    Where ``toxic`` isn't null the document was counted as such, and is compared without itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        table = {c: shared.value[c].to_numpy() for c in shared.value.column_names}
        known = table["w"]
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                h, off, _ = words_of(part)
                of, own = distinct_words(h, off)
                toxic = part.column(3).to_numpy(zero_copy_only=False).astype(np.float64)  # NaN: not counted
                at = np.minimum(np.searchsorted(known, own.view(np.int64)), max(0, len(known) - 1))
                there = known[at] == own.view(np.int64) if len(known) else np.zeros(len(own), bool)
                row = at[there]
                mark = toxic[of[there]]
                c = [np.minimum(table[f"d{k}"][row] - (mark == k), table[f"c{k}"][row]).astype(np.float64) for k in (0, 1)]
                ratio = model.log_ratio(c[0], c[1], np.maximum, np.log)
                n = part.num_rows
                sums, tops = np.bincount(of[there], ratio, n).astype(np.float64), np.full(n, -np.inf)
                np.maximum.at(tops, of[there], ratio)
                tops = pa.array(np.where(np.isinf(tops), 0.0, tops), mask=np.isinf(tops))
                names = ["w", "uid", "word", "doc_id", "toxic", "n", "total", "top"]
                uid = part.column(0)
                yield pa.RecordBatch.from_arrays([uid, uid, pa.array(np.zeros(n, bool)), part.column(1), part.column(3), pa.array(np.bincount(of, minlength=n)), pa.array(sums), tops], names)
                rare = np.flatnonzero(~there)
                one = pa.array(of[rare])
                empty = lambda kind: pa.nulls(len(rare), kind)
                yield pa.RecordBatch.from_arrays([signed(own[rare]), uid.take(one), pa.array(np.ones(len(rare), bool)), empty(part.column(1).type), part.column(3).take(one), empty(pa.int64()), empty(pa.float64()), empty(pa.float64())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    rows = numbered.mapInArrow(run, f"w long, uid long, word boolean, doc_id {kind}, toxic int, n long, total double, top double")
    joined = rows.join(counts, "w", "left")
    left = lambda k: F.coalesce(F.least(F.col(f"d{k}") - F.when(F.col("toxic") == k, 1).otherwise(0), F.col(f"c{k}")), F.lit(0)).cast("double")
    ratio = F.when(F.col("word"), model.log_ratio(left(0), left(1), lambda a, b: F.greatest(a, F.lit(b)), F.log))
    g = joined.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.sum("n").alias("n"), F.sum(F.coalesce("total", ratio)).alias("total"), F.max(F.coalesce("top", ratio)).alias("top"))
    return g.select("doc_id", "toxic", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("mean"), F.coalesce("top", F.lit(0.0)).alias("top"))


def logistic(features: np.ndarray, toxic: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> list[float]:
    """Intercept and weights of a logistic function, by Newton's method with a small ridge on features of unit spread.

    No weight is below zero: what says toxic can't lower a score. Documents compared without themselves lose words that they alone hold, which a small class feels most, so that
    of few documents the plain fit may turn a feature's sign. Of such features the one with the lowest weight is left out and the rest fitted anew.
    """
    spread = np.maximum(features.std(axis=0), 1e-9)
    used = np.arange(features.shape[1])
    while True:
        x = np.column_stack([np.ones(len(features)), features[:, used] / spread[used]])
        w, pull = np.zeros(x.shape[1]), np.array([1e-6, *[ridge] * len(used)])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - toxic) + pull * w)
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        if not len(used) or w[1:].min() >= 0:
            break
        used = np.delete(used, np.argmin(w[1:]))
    weights = np.zeros(features.shape[1])
    weights[used] = w[1:] / spread[used]
    return [float(w[0]), *weights.tolist()]


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, int, DataFrame]:
    """The marks (doc_id, toxic) that may be learned from, as a table; their number; and the texts (doc_id, text) that may be."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("toxic"))
    marks = materialize(marks.where(~held_out(F.col("doc_id"))), "marks")
    return marks, marks.count(), docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())


@dataclass
class Fitted:
    """A model with its table of counts and the frequent words of it."""

    model: Model
    counts: DataFrame
    frequent: pa.Table


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", share: float = SHARE, sample: int = SAMPLE, slice_bytes: int = 6_000_000) -> Fitted:
    """Counts of all labelled rows that aren't held out, and a logistic function fitted on a bounded sample of them."""
    marks, n_marks, texts = learned(docs, labels, id_col, text_col, label_col)
    labelled = texts.join(F.broadcast(marks) if n_marks <= BROADCAST_LABELS else marks, "doc_id")
    counts = materialize(word_counts(labelled, slice_bytes), "word-counts")
    own = [F.least(f"d{k}", f"c{k}") for k in (0, 1)]
    stats = [x for c in own for x in (F.sum(c), F.count_if(c > 0), F.count_if(c == 1), F.count_if(c == 2))]
    s = [x or 0 for x in counts.agg(*stats, F.sum(F.col("d0") + F.col("d1"))).first()]
    discount = [min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5 for n1, n2 in (s[2:4], s[6:8])]
    toxic = marks.agg(F.avg("toxic")).first()[0] or 0.0
    words = counts.count()
    model = Model([s[0], s[4]], [s[1], s[5]], discount, s[0] + s[4] + words + 1, toxic)
    frequent = counts.where(F.col("d0") + F.col("d1") >= share * s[8]).orderBy("w").toArrow().combine_chunks()
    fitted = Fitted(model, counts, frequent)
    if all(model.total):
        chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / n_marks) * (1 << 30))
        some = texts.where(chosen).join(F.broadcast(marks.where(chosen)), "doc_id").select("doc_id", "text", "toxic")
        seen = compared(some, counts, frequent, model, slice_bytes).groupBy("doc_id").agg(*[F.avg(c).alias(c) for c in ("toxic", "mean", "top")])
        seen = seen.select("mean", "top", "toxic").toArrow()
        x = np.column_stack([seen[c].to_numpy() for c in ("mean", "top", "toxic")])
        x = x[np.lexsort(x.T)]
        if len(x):
            model.logistic = logistic(x[:, :2], x[:, 2])
    drop(marks)
    return fitted


def score(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 6_000_000) -> DataFrame:
    """(doc_id, score, mean, top) of every row, from its text alone."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("int").alias("toxic"))
    if not all(fitted.model.total):
        return rows.select("doc_id", F.lit(float(fitted.model.share)).alias("score"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("top"))
    found = compared(rows, fitted.counts, fitted.frequent, fitted.model, slice_bytes)
    return found.select("doc_id", fitted.model.score(F.col("mean"), F.col("top")).alias("score"), "mean", "top")
