"""Benchmark decontamination: a broadcast hash set of test n-grams, and a scan of all training windows.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. A window is 10 consecutive words of a
benchmark item; an item of fewer words, but not none, is one window. Words of the benchmark get numbers, a
window is found by a hash over the numbers and verified by comparing all of them, so a hit is never a collision.
Texts stay where they are: the only thing that moves is the table of windows.

The table is broadcast while it takes no more than ``BROADCAST_BYTES``, by a count of the benchmark's words. A larger benchmark is cut by a hash of the
item into parts of that size on average, each scanned by its own pass: its windows are built, broadcast and given up when its hits are written. The passes' hits are put together by document.

Defined results: a null text has no words and no hits; repeated items count by their own id, and a null id as the text
``null``; an item that is there twice counts once; repeated rows stay; very long texts are scanned alone; an empty benchmark hits nothing; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.bpe import runs_of
from skillgrid.llm.ragged import offsets_of, slices, tidy
from skillgrid.session import fresh, materialize

WINDOW = 10
#: Most bytes of one broadcast table: its texts, and 12 for each of their words.
BROADCAST_BYTES = 64 << 20

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-cases A-Z and makes every ASCII byte that isn't a letter or digit a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def fold(text: pa.Array) -> pa.Array:
    """Texts with words in lower case and spaces for all else; bytes keep their places."""
    if text.offset or text.null_count:
        text = pa.concat_arrays([pc.fill_null(text, "")])
    offsets, data = text.buffers()[1:]
    ends = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1]
    raw = bytes(data)[ends[0] : ends[-1]] if data is not None else b""
    return pa.StringArray.from_buffers(len(text), pa.py_buffer((ends - ends[0]).astype(np.int32).tobytes()), pa.py_buffer(raw.translate(FOLD)))


def mixed(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """32 bits of hash of ``width`` codes from each start; what they find is verified."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(width):
        x = codes[starts + j].astype(np.uint64) * MULTIPLIER
        out = (out ^ (x ^ (x >> np.uint64(31)))) * MULTIPLIER
    return (out >> np.uint64(32)).astype(np.uint32)


class Windows:
    """The windows of a benchmark's items, by their number of words: the words' numbers once, and of each window its start and 32 bits of hash, in order of the hash."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = [n for n, _ in items]
        words, self.off = runs_of(fold(pa.array([t for _, t in items], pa.string())))
        coded = words.dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int32) + 1
        n = np.diff(self.off)
        self.by_width = []
        for width in sorted({min(int(x), window) for x in n if x}):
            of = np.flatnonzero(n >= window) if width == window else np.flatnonzero(n == width)
            per = n[of] - width + 1
            starts = np.repeat(self.off[:-1][of] - offsets_of(per)[:-1], per) + np.arange(per.sum())
            key = mixed(self.codes, starts, width)
            order = np.argsort(key, kind="stable")
            self.by_width.append((width, key[order], starts[order].astype(np.int32)))

    def hits(self, codes: np.ndarray, off: np.ndarray):
        """(start of word, width, number of the item) of every occurrence, for texts whose words begin at ``off``."""
        unknown = np.concatenate([[0], np.cumsum(codes == 0)])
        ends = np.repeat(off[1:], np.diff(off))
        for width, key, starts in self.by_width:
            at = np.arange(len(codes) - width + 1)
            at = at[(unknown[at + width] == unknown[at]) & (at + width <= ends[at])] if len(at) else at
            if not len(at):
                continue
            h = mixed(codes, at, width)
            low, high = np.searchsorted(key, h, "left"), np.searchsorted(key, h, "right")
            some = np.flatnonzero(high > low)
            n = high[some] - low[some]
            if not len(some):
                continue
            begin = np.repeat(at[some], n)
            test = starts[np.arange(n.sum()) + np.repeat(low[some] - offsets_of(n)[:-1], n)]
            same = np.ones(len(begin), bool)
            for j in range(width):
                same &= codes[begin + j] == self.codes[test + j]
            yield begin[same], width, np.searchsorted(self.off, test[same], "right") - 1


def windows_of(docs: DataFrame, items: list[tuple[str, str]], window: int = WINDOW) -> Broadcast:
    """The windows of some items, broadcast."""
    return docs.sparkSession.sparkContext.broadcast(Windows(items, window))


def scan(docs: DataFrame, shared: Broadcast, slice_bytes: int = 4_000_000) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, items): spans are the hit words as [from, to) pairs in order, items the ids with hits. ``shared``: from ``windows_of``."""

    def run(batches):
        table = shared.value
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                words, off = runs_of(fold(part.column(2)))
                codes = pc.fill_null(pc.add(pc.index_in(words, value_set=table.words), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                covered = np.zeros(len(codes) + 1, np.int64)
                pairs = []
                for begin, width, item in table.hits(codes, off):
                    np.add.at(covered, begin, 1)
                    np.add.at(covered, begin + width, -1)
                    pairs.append(np.stack([np.searchsorted(off, begin, "right") - 1, item], axis=1))
                hit = np.cumsum(covered)[:-1] > 0
                n = part.num_rows
                spans, found = [[]] * n, [[]] * n
                if pairs:
                    both = np.unique(np.concatenate(pairs), axis=0)
                    hits, first = np.unique(both[:, 0], return_index=True)
                    for d, a, b in zip(hits, first, [*first[1:], len(both)]):
                        found[d] = [table.names[i] for i in both[a:b, 1]]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[off[d] : off[d + 1]].astype(np.int8), [0]])))
                        spans[d] = edge.tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(off), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], ["doc_id", "text_hash", "n_words", "spans", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_hash", "text").mapInArrow(tidy(run), f"doc_id {kind}, text_hash long, n_words long, spans array<long>, items array<string>")


def merged(spans: Column) -> Column:
    """The union of several lists of [from, to) pairs, given as an array of arrays."""
    pairs = lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.size(x) - 2, F.lit(2)), lambda i: F.struct(F.get(x, i).alias("a"), F.get(x, i + 1).alias("b")))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    longer = lambda acc, p: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.greatest(last(acc), p["b"])))
    step = lambda acc, p: F.when(p["a"] <= last(acc), longer(acc, p)).otherwise(F.concat(acc, F.array(p["a"], p["b"])))
    return F.aggregate(F.array_sort(F.flatten(F.transform(spans, pairs))), F.array().cast("array<bigint>"), step)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, items) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    tests = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    tests = tests.distinct()
    in_table = F.octet_length("text") + 12 * F.size(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    size = tests.agg(F.sum(in_table)).first()[0] or 0
    passes = -(-size // most_bytes) or 1
    if passes == 1:
        return scan(rows, windows_of(rows, [tuple(r) for r in tests.collect()], window))
    tests = tests.withColumn("pass", F.pmod(F.xxhash64("item", "text"), F.lit(passes)))
    found = None
    for p in range(passes):  # one table of windows at a time: it goes when its hits are written
        shared = windows_of(rows, [tuple(r) for r in tests.where(F.col("pass") == p).drop("pass").collect()], window)
        hits = scan(rows, shared)
        part = materialize((hits if p == 0 else hits.where(F.size("spans") > 0)).withColumn("row", F.lit(int(p == 0))), "hits")
        shared.destroy()
        found = part if found is None else found.unionAll(part)
    both = found.groupBy("doc_id", "text_hash", "n_words").agg(merged(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("row").cast("int").alias("copies"))
    return both.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("doc_id", "text_hash", "n_words", "spans", "items")


def report(hits: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from ``contamination``."""
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 1), F.lit(0).cast("long"), lambda a, i: a + F.when(i % 2 == 1, F.element_at("spans", i + 1)).otherwise(-F.element_at("spans", i + 1)))
    n_hit = F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    names = F.array_sort(F.array_distinct("items"))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def cut(text: str | None, spans: list[int] | None) -> str | None:
    """A text without the words of the spans and what stands between them."""
    if text is None or not spans:
        return text
    raw = text.encode()
    words = list(WORD.finditer(raw.translate(FOLD)))
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[at : words[a].start()])
        at = words[b - 1].end()
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit spans of their texts; all columns stay.

    Only ids and hashes of hit texts are joined back, never scan results of clean ones.
    """
    hits = contamination(docs, benchmark, id_col, text_col, item_col, item_text, window).where(F.size("spans") > 0)
    i, t, p = (fresh(n, docs.columns) for n in ("hit_id", "hit_text", "hit_spans"))
    hits = hits.select(F.col("doc_id").alias(i), F.col("text_hash").alias(t), F.col("spans").alias(p)).dropDuplicates([i, t])
    same = docs[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(t))
    if remove == "documents":
        return docs.join(hits, same, "left_anti")
    cutter = F.udf(cut, "string")
    joined = docs.join(hits, same, "left")
    return joined.withColumn(text_col, F.when(F.col(p).isNull(), F.col(text_col)).otherwise(cutter(F.col(text_col), F.col(p)))).select(*docs.columns)
