"""Toxicity by class-conditional Kneser-Ney models of words after the word before them.

The labelled documents make one model for toxic and one for ordinary text, interpolated in three steps; y is a class, n_y counts the places of a pair of words in it, N_y(w)
the different words before w, F_y(v) those after v, C_y(v) the places with a word after v:

    P_y(w | v) = max(n_y(v, w) - D2_y, 0) / C_y(v) + D2_y F_y(v) / C_y(v) * P_y(w)        (P_y(w) where y has nothing after v)
    P_y(w)     = max(N_y(w) - D1_y, 0) / N_y + D1_y V_y / N_y * B(w)                       (N_y: the sum of N_y(w); V_y: words with one)
    B(w)       = (N_0(w) + N_1(w) + 1) / (N_0 + N_1 + V + 1)                               (the two classes' together)

The last step's counts are shared, so that rare and unseen words are smoothed alike in both. Discounts are n1 / (n1 + 2 n2) of the counts that they are taken from. A text begins with
a word of its own, before its first one. All counts are exact but for hashes of 64 bits that stand for words, pairs and texts.

A document is compared by its log-likelihoods under both, over all its words in their order, normalised by their number, and at its most telling word (the largest log-ratio of P_y(w)).
The logistic function of `toxicity` over the two makes the score; it is fitted on at most about ``toxicity.SAMPLE`` labelled documents, each compared as if it hadn't been counted itself.

How it runs: the log-ratio of a place is r(w) + g(v), plus d(v, w) where labelled text has the pair, with r and d of what the models say of the word and of the pair, and g of the weights
that they back off by. Pairs of labelled texts are counted once and kept in ``PASSES`` parts by their hash; the counts of words are summed from these. All texts are
then read once for each pass, so that only that part of their pairs is on disk at once: what the models say of the most frequent words and pairs (at most 1 / ``share`` each, two million) is
broadcast and looked up where texts are read, and of the others only those move that labelled text may have by a table of bits (16 MB a pass at most, wherever it is fuller more rows move), to be joined
with what the models say of them and summed by text. So no task gets all rows of a frequent word or pair. Labels are handled as in `toxicity`, and so are odd rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.llm import toxicity
from skillgrid.llm.bpe import runs_of
from skillgrid.llm.decontaminate import fold
from skillgrid.llm.ragged import offsets_of, slices
from skillgrid.llm.substrings import word_codes
from skillgrid.session import drop, materialize, release

#: Parts that pairs are dealt into.
PASSES = 3
#: The words, and the pairs, that are broadcast at most: one over this.
SHARE = 5e-7
#: The table of bits of a pass has 8 for each key, and at most two to the power of this.
MOST_BITS = 27
#: Bits that are set at once, as a power of two: 64 KB.
PIECE = 19
#: What stands before the first word of a text.
START = 0
COUNTS = ["before0", "before1", "after0", "after1", "places0", "places1"]


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``F.xxhash64(v, w)`` of two long columns, on arrays."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.full(len(v), 42, np.uint64)
    for x in (v, w):
        h = (h + five + np.uint64(8)) ^ (rotated(x * two, 31) * one)
        h = rotated(h, 27) * one + four
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        h ^= h >> np.uint64(32)
    return h


@dataclass
class Places:
    """The places of a slice's texts: the different words (their hashes), and of each place which of these it has, the hash of its word and of the word before, and its text."""

    different: np.ndarray
    code: np.ndarray
    v: np.ndarray
    w: np.ndarray
    of: np.ndarray
    length: np.ndarray  # words of every text


def places(part: pa.RecordBatch, column: str) -> Places:
    words, off = runs_of(fold(part.column(part.schema.get_field_index(column))))
    different, code = word_codes(words)
    w = different[code]
    v = np.empty_like(w)
    v[1:] = w[:-1]
    n = np.diff(off)
    v[off[:-1][n > 0]] = START
    return Places(different, code, v, w, np.repeat(np.arange(len(n)), n), n)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many parts a hash belongs to, by its upper half."""
    return ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def part_column(key: Column, parts: int) -> Column:
    """``part_of`` on a long column."""
    return F.shiftrightunsigned(F.shiftrightunsigned(key, 32) * F.lit(parts).cast("long"), 32).cast("int")


def packed(columns: tuple[np.ndarray, ...]) -> bytes:
    """Columns, the first of which ascends, in little space: broadcasts are files at the driver and at every executor."""
    first = columns[0].view(np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.diff(first, prepend=np.uint64(0))), *[pa.array(c) for c in columns[1:]]], [str(i) for i in range(len(columns))])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    first, *others = (c.to_numpy() for c in table.columns)
    return np.cumsum(first, dtype=np.uint64).view(np.int64), *others


def counted(of: np.ndarray, key: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Where the different (text, key) are first, and how often each is there; of ``also``, the sum over its places."""
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(key)))
    if also is None:
        return order[at], times
    return order[at], times, np.add.reduceat(also[order], at) if len(at) else also[:0]


class Known:
    """Finds hashes among ascending, different ones: a table has where those of each range begin, of which most ranges have one or two."""

    def __init__(self, known: np.ndarray):
        self.known, self.many = known, 1 << len(known).bit_length()
        if len(known):
            values = self.unsigned(known)
            self.low = values[0]
            self.scale = self.many / (float(values[-1] - self.low) + 1)
            self.start = np.concatenate([[0], np.cumsum(np.bincount(self.range_of(values), minlength=self.many))]).astype(np.int32)

    @staticmethod
    def unsigned(key: np.ndarray) -> np.ndarray:
        return key.view(np.uint64) ^ np.uint64(1 << 63)

    def range_of(self, values: np.ndarray) -> np.ndarray:
        return np.minimum((values - self.low).astype(np.float64) * self.scale, self.many - 1).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which signed keys are known, and the place of each that is."""
        if not len(self.known):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        of = self.range_of(self.unsigned(key))
        at, end = self.start[of], self.start[of + 1]
        there = self.known[np.minimum(at, len(self.known) - 1)] == key
        left = np.flatnonzero(~there & (at + 1 < end))
        while len(left):
            at[left] += 1
            there[left] = hit = self.known[at[left]] == key[left]
            left = left[~hit & (at[left] + 1 < end[left])]
        return there, at


def pair_counts(labelled: DataFrame, number: int, passes: int, slice_bytes: int) -> DataFrame:
    """(v, w, n0, n1) of every pair of the pass: its places in both classes. ``labelled``: (text, toxic)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                at = places(part, "text")
                v, w, of = at.v, at.w, at.of
                key = pair_key(v, w)
                mine = np.flatnonzero(part_of(key, passes) == number)
                toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                _, first, code = np.unique(key[mine], return_index=True, return_inverse=True)
                n = np.bincount(code * 2 + toxic[of[mine]], minlength=2 * len(first)).reshape(-1, 2)
                at = mine[first]
                yield pa.RecordBatch.from_arrays([toxicity.signed(v[at]), toxicity.signed(w[at]), pa.array(n[:, 0]), pa.array(n[:, 1])], ["v", "w", "n0", "n1"])

    found = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "v long, w long, n0 long, n1 long")
    return found.groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def by_word(pairs: DataFrame) -> DataFrame:
    """The counts of words that pairs give: different words before and after, and places with one after."""
    n = [F.col("n0"), F.col("n1")]
    there, none = [(x > 0).cast("long") for x in n], [F.lit(0).cast("long")]
    sides = [("w", [*there, *none * 4]), ("v", [*none * 2, *there, *n])]
    rows = [pairs.select(F.col(key).alias("w"), *[x.alias(c) for x, c in zip(side, COUNTS)]) for key, side in sides]
    return rows[0].unionAll(rows[1]).groupBy("w").agg(*[F.sum(c).alias(c) for c in COUNTS])


def often() -> Column:
    """By what a word is frequent: 1 at least."""
    return F.col("places0") + F.col("places1") + F.col("before0") + F.col("before1")


def most_frequent(rows: DataFrame, n: Column, share: float, total: int) -> int:
    """The least n by which at most 1 / ``share`` of the rows are the most frequent; that share of the total is always enough."""
    cap = int(np.ceil(max(1.0, share * total)))
    counts = sorted(rows.groupBy(F.least(n, F.lit(cap)).alias("n")).count().collect(), reverse=True)
    least, many = cap, 0
    for r in counts:
        many += r["count"]
        if many > 1 / share:
            break
        least = r["n"]
    return least


@dataclass
class Model:
    """What the probabilities need beside the counts of a word or a pair, and the logistic function."""

    total: list[int]
    words: list[int]
    discount: list[float]  # of different words before a word
    pair_discount: list[float]
    shared: int
    share: float  # of toxic documents
    logistic: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])

    def word(self, n, positive=lambda x: F.greatest(x, F.lit(0.0))) -> list:
        """P_y(w) of both classes, of N_0(w) and N_1(w); on columns, and on arrays with their ``positive``."""
        backoff = (n[0] + n[1] + 1.0) / self.shared
        return [positive(n[y] - self.discount[y]) / self.total[y] + self.discount[y] * self.words[y] / self.total[y] * backoff for y in (0, 1)]

    def gained(self, n, after, p, y: int, most=np.maximum):
        """P_y(w | v) over what it backs off to, of a pair's places n, F_y(v) and P_y(w); on arrays, and on columns with their ``most``."""
        return 1 + most(n - self.pair_discount[y], 0.0) / (self.pair_discount[y] * most(after, 1.0) * p)

    def weight(self, after: Column, places: Column, y: int) -> Column:
        """The weight by which P_y(w | v) backs off, of F_y(v) and C_y(v)."""
        return F.when((places > 0) & (after > 0), self.pair_discount[y] * after / places).otherwise(1.0)

    def score(self, mean: Column, top: Column) -> Column:
        if not all(self.total):
            return F.lit(self.share)
        a, b, c = self.logistic
        return 1 / (1 + F.exp(-(F.lit(a) + b * mean + c * top)))


@dataclass
class Fitted:
    """A model, the table of the counts of words, and those of pairs, one for each pass."""

    model: Model
    words: DataFrame
    pairs: list[DataFrame]
    least_word: int  # what makes a word or a pair frequent
    least_pair: int


def discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5


def named(words: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return words.select(F.col("w").alias(key), *columns)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", share: float = SHARE, sample: int = toxicity.SAMPLE, passes: int = PASSES, slice_bytes: int = 6_000_000) -> Fitted:
    """Counts of all labelled rows that aren't held out, and a logistic function fitted on a bounded sample of them."""
    spark = docs.sparkSession
    marks, n_marks, texts = toxicity.learned(docs, labels, id_col, text_col, label_col)
    near = n_marks <= toxicity.BROADCAST_LABELS
    labelled = texts.join(F.broadcast(marks) if near else marks, "doc_id")
    labelled = labelled if near else materialize(labelled, "labelled")
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n_marks)) * (1 << 30))
    some = materialize(labelled.where(chosen).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "sample", cleanup=True)
    parts, halves = [], (passes + 1) // 2  # counting takes less disk than scoring
    for number in range(halves):
        found = pair_counts(labelled, number, halves, slice_bytes).withColumn("part", part_column(F.xxhash64("v", "w"), passes))
        parts.append(materialize(found, "pairs", cleanup=True, by=("part",)))
        release(spark)
    if not near:
        drop(labelled)
    pairs = reduce(DataFrame.unionAll, parts)
    words = materialize(by_word(pairs), "words", cleanup=True)
    release(spark)
    stats = [x for c in COUNTS[:2] for x in (F.sum(c), F.count_if(F.col(c) > 0), F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2))]
    s = [x or 0 for x in words.agg(*stats, F.count_if(F.col("before0") + F.col("before1") > 0), F.sum(F.col("places0") + F.col("places1"))).first()]
    few = pairs.agg(*[F.count_if(F.col(c) == k) for c in ("n0", "n1") for k in (1, 2)]).first()
    toxic = marks.agg(F.avg("toxic")).first()[0] or 0.0
    model = Model([s[0], s[4]], [s[1], s[5]], [discount(*s[2:4]), discount(*s[6:8])], [discount(*few[:2]), discount(*few[2:])], s[0] + s[4] + s[8] + 1, toxic)
    least = most_frequent(pairs, F.col("n0") + F.col("n1"), share, s[9])
    if all(model.total):
        x = without_themselves(some, pairs, words, share * s[9], least, model, slice_bytes)
        x = x[np.lexsort(x.T)]
        if len(x):
            model.logistic = toxicity.logistic(x[:, :2], x[:, 2])
    drop(some)
    release(spark)
    return Fitted(model, words, [pairs.where(F.col("part") == k).drop("part") for k in range(passes)], most_frequent(words, often(), share, 2 * s[9]), least)


def without_themselves(some: DataFrame, pairs: DataFrame, words: DataFrame, least_word: float, least: int, model: Model, slice_bytes: int) -> np.ndarray:
    """(mean, top, toxic) of every document of the sample, (uid, doc_id, text, toxic), by the counts without its own.

    Frequent words and pairs are broadcast; the counts of a document's others come to it as lists, but for pairs that it alone has.
    """
    n = F.col("n0") + F.col("n1")
    keyed = pairs.select(F.xxhash64("v", "w").alias("k"), "n0", "n1")
    of_words, of_pairs = by_key(words.where(F.col("places0") + F.col("places1") >= least_word).select("w", *COUNTS)), by_key(keyed.where(n >= least))
    shared = some.sparkSession.sparkContext.broadcast((np.stack(of_words), np.stack(of_pairs)))

    def rare(batches):
        """Of every document the different words and pairs that aren't frequent, and the places of pairs (null of words)."""
        known, known_pairs = (Known(table[0]) for table in shared.value)
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                at = places(part, "text")
                of, own = toxicity.distinct_words(at.w, offsets_of(at.length))
                of, own = np.concatenate([of, np.arange(part.num_rows)]), np.concatenate([own.view(np.int64), np.full(part.num_rows, START, np.int64)])
                there, _ = known.find(own)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of[~there])), pa.array(own[~there]), pa.nulls(int((~there).sum()), pa.int64())], ["uid", "k", "times"])
                key = pair_key(at.v, at.w).view(np.int64)
                there, _ = known_pairs.find(key)
                of, key = at.of[~there], key[~there]
                first, times = counted(of, key)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of[first])), pa.array(key[first]), pa.array(times)], ["uid", "k", "times"])

    def run(batches):
        tables = [(Known(table[0]), table[1:]) for table in shared.value]
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                at = places(part, "text")
                off = offsets_of(at.length)
                lists = [(np.stack([c.to_numpy() for c in x.values.flatten()]), x.offsets.to_numpy()) for x in (part.column(3), part.column(4))]
                toxic = part.column(2).to_numpy()
                found = np.zeros((part.num_rows, 2))
                for i in np.flatnonzero(at.length):
                    few = [values[:, bounds[i] : bounds[i + 1]] for values, bounds in lists]
                    few = [x[:, np.argsort(x[0])] for x in few]
                    few = [(Known(x[0]), x[1:]) for x in few]
                    found[i] = alone(at.v[off[i] : off[i + 1]], at.w[off[i] : off[i + 1]], int(toxic[i]), [tables[1], few[0]], [tables[0], few[1]], model)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(found[:, 0]), pa.array(found[:, 1])], ["doc_id", "toxic", "mean", "top"])

    own = materialize(some.select("uid", "text").mapInArrow(rare, "uid long, k long, times long"), "own", cleanup=True)
    listed = lambda rows, names, to: rows.groupBy("uid").agg(F.collect_list(F.struct(*names)).alias(to))
    # a pair that others have too is in two places at least
    others = own.where("times IS NOT NULL").join(keyed.where((n > 1) & (n < least)), "k").where(n > F.col("times"))
    few = own.where("times IS NULL").select("uid", F.col("k").alias("w")).join(words, "w")
    rows = some.join(listed(others, ["k", "n0", "n1"], "others"), "uid", "left").join(listed(few, ["w", *COUNTS], "few"), "uid", "left")
    none = [F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("others", "few")]
    kind = some.schema["doc_id"].dataType.simpleString()
    compared = rows.select("text", "doc_id", "toxic", *none).mapInArrow(run, f"doc_id {kind}, toxic int, mean double, top double")
    of_ids = materialize(compared.groupBy("doc_id").agg(*[F.avg(c).alias(c) for c in ("mean", "top", "toxic")]), "seen", cleanup=True)
    seen = of_ids.toArrow()
    shared.destroy()
    drop(own, of_ids)
    return np.column_stack([seen[c].to_numpy() for c in ("mean", "top", "toxic")])


def alone(v: np.ndarray, w: np.ndarray, own: int, pairs: list[tuple[Known, np.ndarray]], tables: list[tuple[Known, np.ndarray]], model: Model) -> tuple[float, float]:
    """(mean, top) of one document by the counts without its own. ``pairs``: pairs with n0 and n1, between them all that others have too; ``tables``: words with their counts, between them all of its words."""
    key, first, times = np.unique(pair_key(v, w), return_index=True, return_counts=True)
    n = np.zeros((2, len(key)), np.int64)
    n[own] = times
    for known, table in pairs:
        there, at = known.find(key.view(np.int64))
        n[:, there] = table[:, at[there]]
    n[own] -= times
    lost = n[own] == 0
    words, code = np.unique(np.concatenate([v[first], w[first]]).view(np.int64), return_inverse=True)
    before_it, it = code[: len(key)], code[len(key) :]
    counts = np.zeros((6, len(words)))
    for known, table in tables:
        there, at = known.find(words)
        counts[:, there] = table[:, at[there]]
    before, after, places_after = counts[:2], counts[2:4], counts[4:]
    before[own] -= np.bincount(it, lost, len(words))
    after[own] -= np.bincount(before_it, lost, len(words))
    places_after[own] -= np.bincount(before_it, times, len(words))
    single = model.word(before, lambda x: np.maximum(x, 0.0))
    p = []
    for y, d in enumerate(model.pair_discount):
        f, c = after[y][before_it], places_after[y][before_it]
        p.append(np.where(c > 0, (np.maximum(n[y] - d, 0.0) + d * f * single[y][it]) / np.maximum(c, 1), single[y][it]))
    return float(np.log(p[1] / p[0]) @ times / times.sum()), float(np.log(single[1] / single[0])[it].max())


def of_words(fitted: Fitted, number: int) -> DataFrame:
    """(k, a, b, n) of the words of the pass: their hash, r, g and how often they are."""
    model, c = fitted.model, {x: F.col(x) for x in COUNTS}
    p = model.word([c["before0"], c["before1"]])
    g = F.log(model.weight(c["after1"], c["places1"], 1) / model.weight(c["after0"], c["places0"], 0))
    mine = fitted.words.where(part_column(F.col("w"), len(fitted.pairs)) == number)
    return mine.select(F.col("w").alias("k"), F.log(p[1] / p[0]).alias("a"), g.alias("b"), often().alias("n"))


def of_pairs(pairs: DataFrame, fitted: Fitted, shared) -> DataFrame:
    """(k, a) of pairs: their hash and d. ``shared``: w, before0, before1, after0, after1 of the frequent words, by w; pairs with another word are joined with the counts of words."""
    model, names = fitted.model, COUNTS[:4]

    def looked_up(batches, both):
        names, *counts = unpacked(shared.value)
        known = Known(names)
        for batch in batches:
            v, w, *n = (x.to_numpy() for x in batch.columns)
            (in_v, at_v), (in_w, at_w) = known.find(v), known.find(w)
            there = in_v & in_w
            if not both:
                yield batch.filter(pa.array(~there))
                continue
            at_v, at_w = at_v[there], at_w[there]
            p = model.word([x[at_w].astype(np.float64) for x in counts[:2]], lambda x: np.maximum(x, 0.0))
            gained = [model.gained(n[y][there], counts[2 + y][at_v], p[y], y) for y in (0, 1)]
            k = pair_key(v[there].view(np.uint64), w[there].view(np.uint64))
            yield pa.RecordBatch.from_arrays([toxicity.signed(k), pa.array(np.log(gained[1] / gained[0]))], ["k", "a"])

    rows = pairs.select("v", "w", "n0", "n1")
    known = rows.mapInArrow(lambda batches: looked_up(batches, True), "k long, a double")
    if fitted.least_word <= 1:  # all words are
        return known
    others = rows.mapInArrow(lambda batches: looked_up(batches, False), "v long, w long, n0 long, n1 long")
    others = others.join(named(fitted.words, "w", names[:2]), "w").join(named(fitted.words, "v", names[2:]), "v")
    most = lambda x, least: F.greatest(x, F.lit(least))
    p = model.word([F.col(c) for c in names[:2]])
    gained = [model.gained(F.col(f"n{y}"), F.col(names[2 + y]).cast("double"), p[y], y, most) for y in (0, 1)]
    return known.unionAll(others.select(F.xxhash64("v", "w").alias("k"), F.log(gained[1] / gained[0]).alias("a")))


def by_key(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """The columns of a bounded number of rows, ordered by the first."""
    found = rows.toArrow().combine_chunks()
    columns = [c.to_numpy() for c in found.columns]
    order = np.argsort(columns[0])
    return tuple(c[order] for c in columns)


def bits_of(keys: DataFrame, many: int) -> np.ndarray:
    """A table of bits, of which those are set that the lowest bits of k number; about ``many`` keys."""
    power = int(np.clip(np.ceil(np.log2(8 * many + 1)), PIECE, MOST_BITS))

    def run(batches):
        pieces = {}
        for batch in batches:
            piece, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for one in np.unique(piece):
                pieces.setdefault(one, np.zeros(1 << PIECE, bool))[at[piece == one]] = True
        names = list(pieces)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([np.packbits(pieces[one], bitorder="little").tobytes() for one in names], pa.binary())], ["piece", "bits"])

    at = F.col("k").bitwiseAND(F.lit((1 << power) - 1))
    dealt = keys.select(F.shiftright(at, PIECE).cast("int").alias("piece"), at.bitwiseAND(F.lit((1 << PIECE) - 1)).cast("int").alias("at"))
    table = materialize(dealt.repartition("piece").mapInArrow(run, "piece int, bits binary"), "bits", cleanup=True)
    bits = np.zeros((1 << (power - PIECE), 1 << (PIECE - 3)), np.uint8)
    for r in table.collect():
        bits[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    drop(table)
    return bits.reshape(-1)


def may_have(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def compared(docs: DataFrame, table: DataFrame, shared, fitted: Fitted, number: int, slice_bytes: int) -> DataFrame:
    """(t, n, total, top) of every text of (t, text): its words, and by the words and pairs of the pass the sum of their log-ratios and the largest of a word.

    ``table``: (k, a, b) of the words and pairs that aren't frequent; ``shared``: those of the frequent words, those of the frequent pairs, each by k, and the bits of the others.
    """
    passes = len(fitted.pairs)
    p = fitted.model.word([0.0, 0.0], lambda x: max(x, 0.0))
    unseen = float(np.log(p[1] / p[0]))

    def run(batches):
        (known, a, b), (known_pairs, d) = (unpacked(x) for x in shared.value[:2])
        known, known_pairs = Known(known), Known(known_pairs)
        bits = np.frombuffer(pa.decompress(shared.value[2], shared.value[3], codec="zstd"), np.uint8)
        for batch in batches:
            for part in slices(batch, "text", slice_bytes, tidy_each=False):
                at = places(part, "text")
                n, of = part.num_rows, at.of
                full = np.flatnonzero(at.length)
                followed = np.zeros(len(of), np.int64)
                followed[:-1] = of[1:] == of[:-1]
                # what each of the different words adds, itself and before another
                mine = part_of(at.different, passes) == number
                ours = np.flatnonzero(mine)
                there, where = known.find(at.different[ours].view(np.int64))
                asked = np.zeros(len(mine), bool)
                asked[ours[~there]] = may_have(bits, at.different[ours[~there]])
                itself, before = np.where(mine & ~asked, unseen, 0.0), np.zeros(len(mine))
                itself[ours[there]], before[ours[there]] = a[where[there]], b[where[there]]
                value = itself[at.code]
                sums, tops = np.bincount(of, value + followed * before[at.code], n).astype(np.float64), np.full(n, -np.inf)
                value[~(mine & ~asked)[at.code]] = -np.inf
                if len(full):
                    tops[full] = np.maximum.reduceat(value, offsets_of(at.length)[full])
                # (text, key, places, places with a word after or -1 of a pair) of those that move: words, pairs, beginnings
                move = np.flatnonzero(asked[at.code])
                first, times, after = counted(of[move], at.w[move], followed[move])
                found = [(of[move[first]], at.w[move[first]], times, after)]
                key = pair_key(at.v, at.w)
                move = np.flatnonzero(part_of(key, passes) == number)
                there, where = known_pairs.find(key[move].view(np.int64))
                sums += np.bincount(of[move[there]], d[where[there]], n)
                move = move[~there]
                move = move[may_have(bits, key[move])]
                first, times = counted(of[move], key[move])
                found.append((of[move[first]], key[move[first]], times, np.full(len(first), -1)))
                if number == 0:  # the part of START
                    there, where = known.find(np.array([START], np.int64))
                    if there[0]:
                        sums[full] += b[where[0]]
                    else:
                        found.append((full, np.full(len(full), START, np.uint64), np.zeros(len(full), np.int64), np.ones(len(full), np.int64)))
                row, key, times, after = (np.concatenate(x) for x in zip(*found))
                names = ["k", "uid", "times", "before", "total", "top"]
                empty = lambda kind, many: pa.nulls(many, kind)
                uid = part.column(0)
                tops = pa.array(np.where(np.isinf(tops), 0.0, tops), mask=np.isinf(tops))
                yield pa.RecordBatch.from_arrays([part.column(1), uid, pa.array(at.length.astype(np.int32)), empty(pa.int32(), n), pa.array(sums), tops], names)
                numbers = [pa.array(x.astype(np.int32)) for x in (times, after)]
                yield pa.RecordBatch.from_arrays([toxicity.signed(key), uid.take(pa.array(row)), *numbers, empty(pa.float64(), len(row)), empty(pa.float64(), len(row))], names)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "t", "text").mapInArrow(run, "k long, uid long, times int, before int, total double, top double")
    joined = rows.join(table, "k", "left")
    word = F.col("before") >= 0
    a = F.coalesce("a", F.when(word, unseen).otherwise(0.0))
    value = F.coalesce("total", F.col("times") * a + F.greatest("before", F.lit(0)) * F.coalesce("b", F.lit(0.0)))
    top = F.coalesce("top", F.when(word & (F.col("times") > 0), a))
    whole = lambda c: F.when(F.col("total").isNotNull(), F.col(c))
    return joined.groupBy("uid").agg(F.max(whole("k")).alias("t"), F.sum(whole("times")).alias("n"), F.sum(value).alias("total"), F.max(top).alias("top")).drop("uid")


def score(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 3_000_000) -> DataFrame:
    """(doc_id, score, mean, top) of every row, from its text alone."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    if not all(fitted.model.total):
        return rows.select("doc_id", F.lit(float(fitted.model.share)).alias("score"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("top"))
    least = [F.lit(fitted.least_word), F.lit(fitted.least_pair)]
    frequent = fitted.words.where(often() >= least[0])
    counts = spark.sparkContext.broadcast(packed(by_key(frequent.select("w", *[F.col(c).cast("int") for c in COUNTS[:4]]))))
    n = F.col("n0") + F.col("n1")

    def a_pass(number: int, pairs: DataFrame) -> DataFrame:
        words, many, few = of_words(fitted, number), pairs.where(n >= least[1]), pairs.where(n < least[1])
        rare = words.where(F.col("n") < least[0]).select("k", "a", "b")
        bits = bits_of(few.select(F.xxhash64("v", "w").alias("k")).unionAll(rare.select("k")), pairs.count())
        known = [packed(by_key(x)) for x in (words.where(F.col("n") >= least[0]).select("k", "a", "b"), of_pairs(many, fitted, counts))]
        shared = spark.sparkContext.broadcast((*known, pa.compress(bits.tobytes(), codec="zstd", asbytes=True), bits.nbytes))
        release(spark)
        table = rare.unionAll(of_pairs(few, fitted, counts).withColumn("b", F.lit(0.0)))
        found = materialize(compared(rows, table, shared, fitted, number, slice_bytes), "compared", cleanup=True)
        shared.destroy()
        return found

    parts = []
    for number, pairs in enumerate(fitted.pairs):
        parts.append(a_pass(number, pairs))
        release(spark)
    counts.destroy()
    # rows of equal texts add up in total and n alike; each pass counted all words
    by_text = reduce(DataFrame.unionAll, parts).groupBy("t").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"))
    mean = F.when(F.col("n") > 0, F.col("total") * len(fitted.pairs) / F.col("n")).otherwise(0.0)
    by_text = by_text.select("t", mean.alias("mean"), F.coalesce("top", F.lit(0.0)).alias("top"))
    return rows.select("doc_id", "t").join(by_text, "t").select("doc_id", fitted.model.score(F.col("mean"), F.col("top")).alias("score"), "mean", "top")
