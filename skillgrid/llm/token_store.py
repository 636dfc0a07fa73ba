"""Token ids in a compressed file format, and back.

Ids are coded with one canonical Huffman code of limited length, made from the counts of the whole
corpus. A store is a folder of two Parquet tables:

``codebook``  (symbol, count, length): the code follows from the lengths alone, in order of (length, symbol).
``blocks``    one row for each block of whole documents: part and seq give the order, doc_ids and n_tokens
              describe the documents, bits holds the codes end to end, and lanes holds the number of bits of each
              run of ``LANE`` symbols, whose running sums are the bit offsets at which decoding can begin.

Blocks are decoded independently of each other, by one table lookup a symbol, all runs of a block at once.

Defined results: documents stand in ascending order of id (nulls first), equal ids in order of their ids' crc32;
ids are whole numbers or null, anything else
is an error; a null or empty text is the end id alone; repeated rows stay; very long texts are encoded alone; an empty table gives an empty store.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillgrid.llm.bpe import encoder
from skillgrid.llm.ragged import offsets_of, slices, tidy
from skillgrid.session import discard, shared_path

#: Symbols between two checkpoints, tokens after which a block ends, and the longest code. The decoder reads windows of at most 25 bits.
LANE, BLOCK, LONGEST = 64, 262_144, 16


# ---- codes -------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code with none over ``longest``, by package-merge; 0 for symbols that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    longest = max(longest, int(np.ceil(np.log2(len(used)))))
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(longest):
        both = np.concatenate([leaves, packages])
        sort = np.argsort(both, kind="stable")
        levels.append(sort < len(leaves))
        both = both[sort]
        both = both[: len(both) // 2 * 2]
        packages = both[0::2] + both[1::2]
    take, n = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(levels):
        mine = int(leaf[:take].sum())
        n[:mine] += 1
        take = 2 * (take - mine)
    out[order] = n
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Codes by (length, symbol), each aligned to the top of ``width`` bits; and that width."""
    width = max(1, int(lengths.max(initial=1)))
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.uint64(1) << (width - lengths[order]).astype(np.uint64)
    codes[order] = (np.cumsum(spans) - spans).astype(np.uint32)
    return codes, width


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, width: int) -> tuple[bytes, bytes]:
    """Bits of a block, and the number of bits of each lane as little-endian unsigned 16-bit integers."""
    if not len(ids):
        return b"", b""
    n = lengths[ids].astype(np.uint64)
    lanes = np.add.reduceat(n, np.arange(0, len(ids), LANE))
    bits = (codes >> (width - lengths.astype(np.int64)).clip(0, 31).astype(np.uint32))[ids].astype(np.uint64)
    for _ in range(2 if width <= 16 else 1):  # neighbours become one code of at most 64 bits
        if len(n) % 2:
            bits, n = np.append(bits, np.uint64(0)), np.append(n, np.uint64(0))
        bits, n = (bits[0::2] << n[1::2]) | bits[1::2], n[0::2] + n[1::2]
    end = np.cumsum(n)
    begin = end - n
    at, free = (begin >> np.uint64(6)).astype(np.int64), np.uint64(64) - (begin & np.uint64(63))
    over = np.maximum(n, free) - free  # bits that go on in the next word
    out = np.zeros((int(end[-1]) + 63) // 64 + 1, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    # shifts stay below 64: a code that fills its word is not moved
    out[at[first]] = np.bitwise_or.reduceat(np.where(over > 0, bits >> over, bits << (free - np.minimum(n, free)) % np.uint64(64)), first)
    split = np.flatnonzero(over)
    out[at[split] + 1] |= bits[split] << (np.uint64(64) - over[split])
    return out.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], lanes.astype("<u2").tobytes()


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for each window of ``width`` bits."""
    codes, width = canonical(lengths)
    symbol, step = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(codes[used])]
    spans = 1 << (width - lengths[order].astype(np.int64))
    total = int(spans.sum())
    symbol[:total], step[:total] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbol, step, width


def unpack(bits: bytes, lanes: bytes, total: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All ids of a block: every lane starts at its checkpoint and gives one symbol a step."""
    symbol, step, width = table
    raw = np.frombuffer(bits + b"\0\0\0\0", np.uint8).astype(np.uint32)
    words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = offsets_of(np.frombuffer(lanes, "<u2"))[:-1]
    out = np.zeros((LANE, len(at)), np.uint32)
    live = len(at)
    for k in range(LANE):
        if k == total - (len(at) - 1) * LANE:
            live -= 1  # the last lane may be short
        now = at[:live]
        seen = (words[now >> 3] >> (32 - width - (now & 7)).astype(np.uint32)) & np.uint32((1 << width) - 1)
        out[k, :live] = symbol[seen]
        now += step[seen]
    return out.T.reshape(-1)[:total]


# ---- writing -----------------------------------------------------------------------------------


def token_ids(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 6_000_000) -> DataFrame:
    """(doc_id, crc, ids): the ids of each whole text and the end id, little-endian, two bytes each where the vocabulary allows."""
    small = encoder(tokenizer).size <= 1 << 16 and (end_id or 0) < 1 << 16
    kind = "<u2" if small else "<u4"

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                ids, n = enc.texts(part.column(1))
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                ends = offsets_of(n)
                whole = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
                size = 2 if small else 4
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((ends * size).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(crc, pa.int64()), pc.cast(data, pa.binary())], ["doc_id", "crc", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, crc long, ids binary").withColumn("wide", F.lit(not small))


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` into a store at ``path``. Of the corpus, only the counts of the vocabulary's ids reach the driver."""
    spark = docs.sparkSession
    token_ids(docs, tokenizer, end_id, id_col, text_col).write.parquet(raw := shared_path(spark, "token-ids"))
    ids = spark.read.parquet(raw)
    size = max(encoder(tokenizer).size, (end_id or 0) + 1)

    def tally(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4" if batch.column(1)[0].as_py() else "<u2"), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["symbol", "count"])

    counted = ids.select("ids", "wide").mapInArrow(tidy(tally), "symbol int, count long").groupBy("symbol").agg(F.sum("count").alias("count")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[counted["symbol"].to_numpy()] = counted["count"].to_numpy()
    lengths = code_lengths(counts)
    book = [(int(s), int(counts[s]), int(lengths[s])) for s in np.flatnonzero(counts)]
    spark.createDataFrame(book, "symbol int, count long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(lengths)

    def encode(batches):
        lengths = shared.value
        codes, width = canonical(lengths)
        part, seq, waiting, held = TaskContext.get().partitionId(), 0, [], 0

        def block():
            ids = np.concatenate([x[1] for x in waiting])
            bits, lanes = pack(ids, codes, lengths, width)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([[x[0] for x in waiting]], pa.list_(pa.int64())), pa.array([[len(x[1]) for x in waiting]], pa.list_(pa.int32())), pa.array([len(ids)], pa.int64()), pa.array([lanes], pa.binary()), pa.array([bits], pa.binary())],
                ["part", "seq", "doc_ids", "n_tokens", "total", "lanes", "bits"],
            )

        for batch in batches:
            for doc_id, ids, wide in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.append((doc_id, np.frombuffer(ids, "<u4" if wide else "<u2")))
                held += len(waiting[-1][1])
                if held >= BLOCK:
                    yield block()
                    seq, waiting, held = seq + 1, [], 0
        if waiting:
            yield block()

    kind = "part int, seq int, doc_ids array<long>, n_tokens array<int>, total long, lanes binary, bits binary"
    ordered = ids.repartitionByRange(F.col("doc_id").asc_nulls_first(), "crc").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc", "ids")
    ordered.select("doc_id", "ids", "wide").mapInArrow(tidy(encode), kind).write.parquet(f"{path}/blocks")
    discard(spark, raw)


# ---- reading -----------------------------------------------------------------------------------


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the store.

    ``start`` sums what comes before: parts by a window over one row a part, blocks by one within their part.
    """
    book = spark.read.parquet(f"{path}/codebook").toArrow()
    lengths = np.zeros(max(book["symbol"].to_pylist(), default=0) + 1, np.uint8)
    lengths[book["symbol"].to_numpy()] = book["length"].to_numpy()
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")

    def decode(batches):
        table = decode_table(shared.value)
        for batch in batches:
            for part, seq, doc_ids, n, total, lanes, bits in zip(*(c.to_pylist() for c in batch.columns)):
                ends = offsets_of(np.array(n, np.int64))
                whole = unpack(bits, lanes, total, table).astype("<u4").tobytes()
                texts = [whole[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]
                cols = [pa.array([part] * len(n), pa.int32()), pa.array([seq] * len(n), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary())] if with_ids else cols, ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    kind = "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = blocks.select("part", "seq", "doc_ids", "n_tokens", "total", "lanes", "bits").mapInArrow(tidy(decode), kind)
    sizes = blocks.select("part", "seq", "total")
    parts = sizes.groupBy("part").agg(F.sum("total").alias("t"))
    before = parts.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("base"))
    within = sizes.select("part", "seq", (F.sum("total").over(Window.partitionBy("part").orderBy("seq")) - F.col("total")).alias("block"))
    begin = within.join(before, "part").select("part", "seq", (F.col("base") + F.col("block")).alias("base"))
    joined = rows.join(begin, ["part", "seq"])
    return joined.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
