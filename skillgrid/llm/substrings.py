"""Substring dedup on a compacted de Bruijn graph of word windows.

Windows of ``K`` words are the edges of the graph, the ``K - 1`` words that two windows in a row share its nodes. Only repeated windows matter, so:

1. every window takes as its key the smallest hash of the ``GRAM``-word grams in it; runs of windows share their key. Keys that occur in two documents
   come from one aggregate with partial minima and maxima. A filter of those keys, at most ``FILTER_BITS`` bits whatever the corpus, goes to the tasks.
   It only spares work: a window that passes without being repeated changes nothing;
2. runs of passing windows, cut where a window's own hash says so, are the edges with what stands before and after them; equal ones become one;
3. a node branches if different words stand before it or follow it anywhere, or if a run begins or ends there: one aggregate over the nodes of
   those stretches. Branching nodes go to the tasks as a filter, too; one that is taken for branching without being so makes a cut more and changes nothing;
4. the documents' runs are cut at branching nodes and at the windows of step 2. What is left in one piece is a path without a branch: wherever one of
   its windows stands, all of it stands, so a path is a repeat as a whole or not at all;
5. a filter of the hashes of paths that two documents have lets on what may be repeated; equal paths compact by a join on their words themselves, with the document of their first occurrence as the source. Occurrences keep their coordinates (document
   and word); those in a later document than the source's are repeats. No hash decides that two stretches are equal;
6. spans go back to their documents by an equi-join on the id and a hash of the text.

Whole texts move once, in step 6. Hot paths shrink before they are shuffled where they are counted, and the joins are plain equi-joins that adaptive execution can
split. What a hash can do: two different words that stand beside the same node and share 64 bits of hash hide a branch, and a repeat may stay; none is made.

Defined results: a null text has no words; a null id counts as the smallest; rows that share an id never repeat each other; texts of fewer than
``K`` words lose nothing; very long texts are handled alone; an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.bpe import runs_of
from skillgrid.llm.ragged import gather, offsets_of, slices
from skillgrid.session import drop, materialize, release

K, GRAM = 13, 5
#: One window in so many ends a stretch, on average; and the largest filter (16 MB).
CUT, FILTER_BITS = 32, 27
LEAST = -(1 << 63)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Stands for the word before or after where there is none.
EDGE = np.uint64(0x5851F42D4C957F2D)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the different words, and which of them each word has."""
    import xxhash

    coded = words.dictionary_encode()
    one = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
    distinct = pc.binary_join(one, "\n")[0].as_py().split("\n") if len(coded.dictionary) else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)), coded.indices.to_numpy()


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word, worked out once for each distinct one."""
    table, code = word_codes(words)
    return table[code]


def combined(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from each place."""
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out = (out ^ h[at + j]) * ODD
    return _mix(out)


class Words:
    """The words of a slice of texts, their hashes, and the windows that begin at them with their keys."""

    def __init__(self, text: pa.Array, k: int = K, gram: int = GRAM):
        self.k = k
        self.words, self.off = runs_of(pc.fill_null(text, ""))
        self.h = word_hashes(self.words)
        n = len(self.h)
        ends = np.repeat(self.off[1:], np.diff(self.off))
        #: Places at which a window begins.
        self.at = np.flatnonzero(np.arange(n) + k <= ends)
        self.doc = np.repeat(np.arange(len(self.off) - 1), np.maximum(np.diff(self.off) - k + 1, 0))
        width, step, low = k - gram + 1, 1, combined(self.h, np.arange(max(n - gram + 1, 0)), gram)
        while 2 * step <= width:
            low = np.minimum(low[: len(low) - step], low[step:])
            step *= 2
        if step < width:
            rest = width - step
            low = np.minimum(low[: len(low) - rest], low[rest:])
        # minima are small numbers: mixed, all bits tell
        self.key = _mix(low[self.at]) if len(self.at) else np.zeros(0, np.uint64)

    def stretches(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The words from each place of ``first`` up to the one of ``last``, exclusive, joined by spaces."""
        places, n = gather(np.arange(len(self.h)), np.stack([first, last], axis=1).ravel(), 2 * np.arange(len(first)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets_of(n), pa.int32()), self.words.take(pa.array(places))), " ")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def repeated_keys(rows: DataFrame, k: int, gram: int, slice_bytes: int) -> DataFrame:
    """Keys that occur in two documents."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                w = Words(part.column(1), k, gram)
                new = np.ones(len(w.key), bool)
                new[1:] = (w.key[1:] != w.key[:-1]) | (w.doc[1:] != w.doc[:-1])
                yield pa.RecordBatch.from_arrays([_signed(w.key[new]), part.column(0).take(pa.array(w.doc[new]))], ["key", "d"])

    keys = rows.select("d", "text").mapInArrow(run, "key long, d long")
    return keys.groupBy("key").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a < b").select("key")


def key_filter(keys: DataFrame) -> tuple[int, np.ndarray]:
    """One bit for the top bits of each key; the number of bits follows the number of keys up to ``FILTER_BITS``."""
    bits = min(FILTER_BITS, max(16, int(np.ceil(np.log2(16 * max(1, keys.count()))))))
    place = F.shiftrightunsigned(F.col("key"), 64 - bits)
    words = keys.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))")).alias("x")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy()] = words["x"].to_numpy().view(np.uint64)
    return bits, out


def passes(known: tuple[int, np.ndarray], key: np.ndarray) -> np.ndarray:
    bits, table = known
    place = key >> np.uint64(64 - bits)
    return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def runs(w: Words, known: tuple[int, np.ndarray], branching: tuple[int, np.ndarray] | None):
    """(first, last, document, whether a stretch goes on before and after) of stretches of passing windows: cut by content, and at branching nodes if given."""
    passed = np.flatnonzero(passes(known, w.key))
    at, doc = w.at[passed], w.doc[passed]
    joined = np.zeros(len(at) + 1, bool)
    joined[1:-1] = (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1])
    begin = ~joined[:-1] | (combined(w.h, at, w.k) % np.uint64(CUT) == 0)
    if branching is not None:
        begin |= passes(branching, combined(w.h, at, w.k - 1))
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return at[first], at[last] if len(first) else at[:0], doc[first], joined[first], joined[last + 1]


def stretches(rows: DataFrame, known: tuple[int, np.ndarray], k: int, gram: int, slice_bytes: int) -> DataFrame:
    """(words, before, after): the distinct stretches of step 2; the first word stands before their first window if ``before``, and the run goes on if ``after``."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                w = Words(part.column(0), k, gram)
                first, last, _, before, after = runs(w, shared.value, None)
                yield pa.RecordBatch.from_arrays([w.stretches(first - before, last + k), pa.array(before), pa.array(after)], ["words", "before", "after"])

    return rows.select("text").mapInArrow(run, "words string, before boolean, after boolean").distinct()


def branching_nodes(found: DataFrame, k: int) -> DataFrame:
    """(key): hashes of the nodes that have more than one word before or after them, or an end of a run."""

    def run(batches):
        for batch in batches:
            words, off = runs_of(batch.column(0))
            h = np.concatenate([word_hashes(words), [EDGE]])
            before, after = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            n = np.diff(off) - k + 1 - before + ~after  # nodes: one before each window, and one after the last if the run ends there
            place, of = gather(np.arange(len(words) + 1), np.stack([off[:-1] + before, off[:-1] + before + n], axis=1).ravel(), 2 * np.arange(len(n)))
            ends = np.cumsum(of)
            begins = ends - of
            left, right = place - 1, place + k - 1
            left[begins[~before]] = len(words)
            right[ends[~after] - 1] = len(words)
            beside = _mix((h[left] * ODD) ^ h[right])
            yield pa.RecordBatch.from_arrays([_signed(combined(h, place, k - 1)), _signed(beside)], ["key", "x"])

    nodes = found.mapInArrow(run, "key long, x long")
    return nodes.groupBy("key").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a < b").select("key")


def paths(rows: DataFrame, known: tuple[int, np.ndarray], branching: tuple[int, np.ndarray], k: int, gram: int, slice_bytes: int) -> DataFrame:
    """(words, d, th, at, n): every path without a branch, n windows from word ``at`` of its document."""
    shared = rows.sparkSession.sparkContext.broadcast((known, branching))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                w = Words(part.column(2), k, gram)
                first, last, doc, _, _ = runs(w, *shared.value)
                of = pa.array(doc)
                cols = [w.stretches(first, last + k), part.column(0).take(of), part.column(1).take(of), pa.array(first - w.off[doc], pa.int32()), pa.array(last - first + 1, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["words", "d", "th", "at", "n"])

    return rows.select("d", "th", "text").mapInArrow(run, "words string, d long, th long, at int, n int")


def maybe(found: DataFrame, twice: tuple[int, np.ndarray]) -> DataFrame:
    """Occurrences of paths whose hash ``p`` passes a filter of those that two documents have."""
    shared = found.sparkSession.sparkContext.broadcast(twice)

    def run(batches):
        for batch in batches:
            key = batch.column(batch.schema.get_field_index("p")).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(passes(shared.value, key)))

    return found.mapInArrow(run, found.schema)


def repeated_paths(rows: DataFrame, k: int = K, gram: int = GRAM, slice_bytes: int = 12_000_000) -> DataFrame:
    """(d, th, at, n, sd): occurrences of compacted paths in documents of a larger id than their source's, ``sd``."""
    spark = rows.sparkSession
    keys = materialize(repeated_keys(rows, k, gram, slice_bytes), "span-keys")
    known = key_filter(keys)
    drop(keys)
    release(spark)
    nodes = materialize(branching_nodes(stretches(rows, known, k, gram, slice_bytes), k), "span-branches")
    branching = key_filter(nodes)
    drop(nodes)
    release(spark)
    found = materialize(paths(rows, known, branching, k, gram, slice_bytes).withColumn("p", F.xxhash64("words")), "span-paths")
    release(spark)
    # by a hash first, which moves no words: what two documents may have in common
    twice = materialize(found.groupBy("p").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a < b").select(F.col("p").alias("key")), "span-twice")
    some = materialize(maybe(found, key_filter(twice)), "span-some")
    drop(found, twice)
    release(spark)
    sources = some.groupBy("p", "words").agg(F.min("d").alias("sd"), F.max("d").alias("b")).where("sd < b").drop("b")
    sources = materialize(sources, "span-sources")  # a table of its own: a join with it, not with an aggregate, is split where a path is in very many documents
    release(spark)
    repeats = materialize(some.join(sources, ["p", "words"]).where("d > sd").select("d", "th", "at", "n", "sd"), "span-repeats")
    drop(some, sources)
    release(spark)
    return repeats


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, gram: int = GRAM, slice_bytes: int = 12_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: kept is the words that no repeated window covers, joined by spaces."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("d"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    span = F.struct("at", (F.col("at") + F.col("n") - 1).alias("to"))
    repeats = repeated_paths(rows, k, gram, slice_bytes)
    spans = repeats.groupBy("d", "th").agg(F.collect_set(span).alias("spans"))  # of rows that are alike in all once
    spans = materialize(spans.select("d", "th", F.col("spans.at").alias("a"), F.col("spans.to").alias("b")), "spans")
    drop(repeats)
    release(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                words, off = runs_of(pc.fill_null(part.column(1), ""))
                cover = np.zeros(len(words) + 1, np.int32)
                has = np.flatnonzero(part.column(2).is_valid().to_numpy(zero_copy_only=False))
                if len(has):
                    a, b = (part.column(c).take(pa.array(has)) for c in (2, 3))
                    n = pc.list_value_length(a).to_numpy().astype(np.int64)
                    base = np.repeat(off[has], n)
                    np.add.at(cover, base + a.flatten().to_numpy(), 1)
                    np.add.at(cover, base + b.flatten().to_numpy() + k, -1)
                gone = np.cumsum(cover)[:-1] > 0
                kept = words.filter(pa.array(~gone)) if gone.any() else words
                ends = offsets_of(~gone)[off]
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kept), " ")
                total = np.diff(off)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(total - np.diff(ends), pa.int64()), text], ["doc_id", "n_words", "n_removed", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(spans, ["d", "th"], "left").select("doc_id", "text", "a", "b")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")
