"""SimHash near-dedup by an inverted index over byte positions.

A text's fingerprint has a bit where more than half of its shingles' hashes have it. Two fingerprints that differ in d bits or
fewer share at least ``8 - d`` of their eight bytes, place by place. So:

1. equal fingerprints are one class;
2. every class is posted under keys of several byte positions: a family of position sets such that any ``8 - d`` positions
   contain one of them (for d = 3: three positions out of the first four, or out of the last four; eight sets of 24 bits);
3. within a posting list the shared positional bytes of pairs are tallied, pairs that reach the guaranteed minimum are
   verified by their differing bits, and a spanning forest of what is linked is kept, never all pairs;
4. links become components by joins.

A posting list of more than ``LIST`` classes is cut into blocks, and each pair of blocks is one piece of work of its own.

One fingerprint finds texts that differ in very little. For texts that share four fifths of their shingles of five words, which differ in nine bits on
average, ``copies`` of it with other hashes and a wider ``bits`` are needed; ``sure`` then keeps the posting lists short.

Defined results: a null text or one without words has fingerprint zero; a text with fewer words than a shingle is one shingle; repeated rows have
equal fingerprints and so one component; very long texts are counted 4,096 shingles at a time; an empty table gives an empty one. A null id counts as the smallest.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.ragged import tidy
from skillgrid.operators.graph import connected_components
from skillgrid.session import fresh, materialize, release

SHINGLE, BITS, SEED, LIST = 3, 3, 42, 4096


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of one text's shingles in order; none of a text without words."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    begin, end = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, copies: int = 1) -> list[int]:
    """``copies`` fingerprints of one text, as signed 64-bit integers: the first from the shingles' hashes, the others from mixtures of them."""
    return fingerprint_of(shingle_hashes(text, shingle), copies)


def fingerprint_of(hashes: np.ndarray, copies: int = 1) -> list[int]:
    """The same of a text's shingle hashes."""
    if not len(hashes):
        return [0] * copies
    set_bits = np.zeros((copies, 64), np.int64)
    for a in range(0, len(hashes), 4096):
        h = hashes[a : a + 4096]
        for c in range(copies):
            set_bits[c] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.packbits(2 * set_bits > len(hashes), axis=1).view(">i8").ravel().tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, copies: int = 1) -> DataFrame:
    """(doc_id, fps) of every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), shingle, copies) for t in batch.column(1)], pa.list_(pa.int64()))], ["doc_id", "fps"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, fps array<long>")


def position_sets(bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any ``8 - bits`` positions contain one: in one half of the eight there are at least half as many, rounded up."""
    least = 8 - bits
    size = -(-least // 2)
    return [s for half in (range(4), range(4, 8)) for s in combinations(half, size)]


def forest(fp: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each linked group within one posting list."""
    raw = fp.view(np.uint8).reshape(-1, 8)
    left = np.arange(len(fp))
    src, dst = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = (raw[left] == raw[at]).sum(axis=1) >= 8 - bits
            near[near] = np.bitwise_count(fp[left[near]].view(np.uint64) ^ fp[at : at + 1].view(np.uint64)) <= bits
            found = left[near]
            src += [at] * len(found)
            dst += found.tolist()
            queue += found.tolist()
            left = left[~near]
    return node[np.array(src, np.int64)], node[np.array(dst, np.int64)]


def list_links(keys: list[np.ndarray], fp: np.ndarray, node: np.ndarray, bits: int, short: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links within all posting lists of a run of rows in order of their keys. Lists of up to ``short`` rows are compared all at once, place by place."""
    new = np.ones(len(fp), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(fp)))
    of, n = np.repeat(np.arange(len(first)), size), np.repeat(size, size)
    src, dst = [], []
    some = np.flatnonzero((n > 1) & (n <= short))
    fs, ns, ls = fp[some].view(np.uint64), node[some], of[some]
    raw = fs.view(np.uint8).reshape(-1, 8)
    for step in range(1, short):
        pair = np.flatnonzero(ls[step:] == ls[:-step]) if len(ls) > step else np.zeros(0, np.int64)
        if not len(pair):
            break
        tally = (raw[pair] == raw[pair + step]).sum(axis=1) >= 8 - bits
        pair = pair[tally]
        pair = pair[np.bitwise_count(fs[pair] ^ fs[pair + step]) <= bits]
        src.append(ns[pair])
        dst.append(ns[pair + step])
    for k in np.flatnonzero(size > short):
        a, b = first[k], first[k] + size[k]
        x, y = forest(fp[a:b], node[a:b], bits)
        src.append(x)
        dst.append(y)
    return (np.concatenate(src), np.concatenate(dst)) if src else (node[:0], node[:0])


def links(classes: DataFrame, bits: int = BITS, sure: int | None = None, most: int = LIST) -> DataFrame:
    """Spanning links (src, dst) between nodes of ``classes`` (node, fps, nodes distinct) of which a fingerprint differs in ``bits`` bits or fewer.

    Posting keys are such that no pair within ``sure`` bits (``bits`` if not given) is missed; a pair beyond it is found where enough bytes happen to agree.
    """
    masks = [sum(255 << (8 * p) for p in s) for s in position_sets(bits if sure is None else sure)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    each = classes.select("node", F.posexplode("fps").alias("c", "fp"))
    posted = each.select("node", "fp", "c", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("s", "key"))
    posted = posted.select("node", "fp", (F.col("c") * len(masks) + F.col("s")).alias("set"), "key")
    rows = in_parts(posted, ["set", "key"], most)

    def run(batches):
        for table in whole_lists(batches, 3):
            cols = [np.ascontiguousarray(table.column(k).to_numpy()) for k in range(5)]
            src, dst = list_links(cols[:3], cols[3], cols[4], bits)
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return rows.select("set", "key", "part", "fp", "node").mapInArrow(tidy(run), "src long, dst long")


def in_parts(posted: DataFrame, keys: list[str], most: int = LIST) -> DataFrame:
    """Posting lists of rows with ``node``, dealt out and sorted by ``keys`` and ``part``: a list of over ``most`` rows is cut into blocks, and each pair of blocks is a part."""
    long = posted.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    long = materialize(long, "long-lists")
    few = long.limit(100_001).count() <= 100_000  # some 30 bytes each
    rows = posted.join(F.broadcast(long) if few else long, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("part", F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")).drop("blocks", "own", "other")
    return rows.repartition(*keys, "part").sortWithinPartitions(*keys, "part")


def whole_lists(batches, n_keys: int):
    """Sorted batches anew, cut so that no list, by the first ``n_keys`` columns, goes on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(n_keys)]
        last = np.logical_and.reduce([c == c[-1] for c in keys])
        n = batch.num_rows - int(last.sum())
        if n:
            yield pa.Table.from_batches([*held, batch.slice(0, n)])
            held = [batch.slice(n)]
        elif held and any(held[-1].column(k)[-1].as_py() != keys[k][0] for k in range(n_keys)):
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, copies: int = 1, sure: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id, n_links) of every row; fp is the first fingerprint, n_links counts the spanning links of its class.

    With ``copies`` fingerprints a text has several chances to be found near another: documents link if any of them is within ``bits``.
    """
    prints = fingerprints(docs, id_col, text_col, shingle, copies)
    node = F.col("fps")[0] if copies == 1 else F.xxhash64("fps")
    prints = materialize(prints.withColumn("node", node), "fingerprints")
    classes = materialize(prints.groupBy("node", "fps").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nameless")), "classes")
    found = materialize(links(classes.select("node", "fps"), bits, sure), "links")
    release(docs.sparkSession)
    nodes = connected_components(found)
    of_class = classes.select("node", "first", "nameless").join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = of_class.groupBy("component").agg(F.when(F.max("nameless"), F.lit(None)).otherwise(F.min("first")).alias("component_id"))
    degree = found.select("src").unionAll(found.select("dst")).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_links"))
    named = of_class.join(smallest, "component").join(degree, "node", "left").select("node", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return prints.select("doc_id", F.col("fps")[0].alias("fp"), "node").join(materialize(named, "named"), "node").select("doc_id", "fp", "component_id", "n_links")


def hexadecimal(fp):
    """A fingerprint as 16 lower-case digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, components: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, of ``components`` (text_hash, component) as rows distinct by text_hash.

    A document is an id, which may be null or shared, and its text: the smallest such pair stays, of rows with that pair one.
    """
    names = [fresh(n, [*docs.columns, "component"]) for n in ("near_id", "near_hash", "dropped_hash")]
    hashed = docs.withColumn(names[1], F.xxhash64(text_col))
    members = hashed.select(F.struct(F.col(id_col).alias("id"), F.col(names[1]).alias("text_hash")).alias("doc")).distinct()
    members = materialize(members.join(components, F.col("doc.text_hash") == F.col("text_hash")).select("doc", "component"), "members")
    first = members.groupBy("component").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first")
    first = materialize(first, "firsts")  # a table, so that a join with it is split where one component is large
    dropped = members.join(first, "component").where(~F.col("doc").eqNullSafe(F.col("first"))).select(F.col("doc.id").alias(names[0]), F.col("doc.text_hash").alias(names[2]))
    kept = hashed.join(dropped, docs[id_col].eqNullSafe(F.col(names[0])) & (F.col(names[1]) == F.col(names[2])), "left_anti")
    return kept.dropDuplicates([id_col, names[1]]).select(*docs.columns)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, copies: int = 1, sure: int | None = None) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, and of these that of the smallest hash of its text."""
    texts = docs.select(F.xxhash64(text_col).alias("doc_id"), F.col(text_col).alias("text"))
    near = near_duplicates(texts, shingle=shingle, bits=bits, copies=copies, sure=sure)
    return keep_one(docs, near.select(F.col("doc_id").alias("text_hash"), F.col("component_id").alias("component")).distinct(), id_col, text_col)
