"""Near copies: SimHash proposes, signatures of minima propose what fingerprints can't tell, and shingles decide.

A text's fingerprint is SimHash's, over the same shingles. Texts whose fingerprints differ in ``BITS`` bits or fewer are proposed as in ``simhash``: posting lists of
positional bytes, tallies, differing bits, a spanning forest of each list. Texts that share four fifths of their shingles differ in nine bits or more on average, and no lists
of byte positions find all pairs that far; these are found by a positional inverted index, too, over other places:

a text's signature is ``ROWS * BANDS`` places, each the minimum of its shingles' hashes under a hash of its own; two texts agree in a place with a
probability that is their similarity. A text is posted under ``BANDS`` keys of ``ROWS`` places: texts of similarity s share a key with a probability
of ``1 - (1 - s**ROWS)**BANDS``, for s = 0.8 all but 3 in 100,000. What is proposed is compared shingle by shingle, so no pair below the asked similarity
is ever linked:

1. texts of the same words are one class;
2. every link of SimHash is verified, and every class of a key compared with the smallest of that key; what is alike becomes components;
3. within a key, pairs that are in different components after that are tallied, a byte a place: those that agree in enough places, ``SURE`` deviations
   fewer than expected of a pair as alike as asked (3 in 100,000 are below it), are verified, and what is alike becomes one component at once. A list of over
   ``BLOCK`` texts is cut into blocks, each pair of blocks a piece of work. So no link is left out because the smallest of a key wasn't alike, texts that only have a
   common passage aren't compared in full, and no pairs leave a list but links that join components.

Defined results: texts without words, null ones among them, are alike; a text with fewer words than a shingle is one shingle; an
empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm import simhash
from skillgrid.llm.ragged import tidy
from skillgrid.llm.simhash import BITS, fingerprint_of, in_parts, keep_one, shingle_hashes, whole_lists
from skillgrid.operators.graph import connected_components
from skillgrid.session import drop, materialize, release

SHINGLE, LEAST, ROWS, BANDS, SURE = 5, 0.8, 4, 20, 4
#: Texts of a block of a long list, whose shingles a task holds.
BLOCK = 512

_MIX = np.random.default_rng(42).integers(0, 2**63, (2, ROWS * BANDS, 1)).astype(np.uint64)
_XOR, _TIMES = _MIX[0], _MIX[1] * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The keys of a set of shingle hashes, as signed 64-bit integers; and one byte of each minimum, by place."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        x = (hashes[None, a : a + 2048] ^ _XOR) * _TIMES
        least = np.minimum(least, ((x ^ (x >> np.uint64(32))) * _TIMES[::-1]).min(axis=1))
    keys = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        keys = (keys ^ least[r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64), (least >> np.uint64(24)).astype(np.uint8).tobytes()


def signatures(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(text_hash, node, size, fp, keys, marks) of rows (text_hash, text): node stands for the words, size is the number of distinct shingles, fp the fingerprint, marks a byte for each minimum."""

    def run(batches):
        import xxhash

        for batch in batches:
            node, size, fp, keys, marks = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                every = shingle_hashes(text, shingle)
                hashes = np.unique(every)
                fp += fingerprint_of(every)
                words = b" ".join(text.encode().lower().split()) if text else b""
                node.append(xxhash.xxh64_intdigest(words) - (1 << 63))
                size.append(len(hashes))
                both = band_keys(hashes) if len(hashes) else (None, None)
                keys.append(both[0])
                marks.append(both[1])
            cols = [batch.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["text_hash", "node", "size", "fp", "keys", "marks"])

    return texts.select("text_hash", "text").mapInArrow(tidy(run), "text_hash long, node long, size long, fp long, keys array<long>, marks binary")


def shingle_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, hashes) of rows (node, text): the distinct hashes of a text's shingles in ascending order."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    return texts.select("node", "text").mapInArrow(tidy(run), "node long, hashes binary")


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the sorted distinct hashes of ``a`` are in ``b``, which is sorted, too."""
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def alike(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose sets (node, hashes) have a similarity of ``least`` or more."""

    def run(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            both = np.fromiter(map(in_both, a, b), np.int64, len(a))
            total = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64) - both
            yield batch.select(["src", "dst"]).filter(pa.array(both / np.maximum(total, 1) >= least))

    with_src = pairs.join(sets.select(F.col("node").alias("src"), F.col("hashes").alias("a")), "src")
    with_both = with_src.join(sets.select(F.col("node").alias("dst"), F.col("hashes").alias("b")), "dst")
    return with_both.select("src", "dst", "a", "b").mapInArrow(tidy(run), "src long, dst long")


def linked(lists: DataFrame, least: float = LEAST) -> DataFrame:
    """Links (src, dst) between nodes of a list (band, key, node, component, size, marks, hashes) that join components of it.

    Pairs in different components whose signatures agree in enough places are verified, the likeliest first; what is linked then counts as one component, so
    a list gives fewer links than it has components, and a large group of copies isn't compared pair by pair.
    """
    enough = least * ROWS * BANDS - SURE * (least * (1 - least) * ROWS * BANDS) ** 0.5

    def links_of(node, component, size, marks, hashes) -> list[tuple[int, int]]:
        names, of = np.unique(component, return_inverse=True)
        root, sets, out = np.arange(len(names)), {}, []

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        def hashes_of(k):
            if k not in sets:
                sets[k] = np.frombuffer(hashes[k], np.uint64)
            return sets[k]

        for a in range(0, len(node) - 1, 64):
            now = np.array([find(c) for c in range(len(names))])[of]
            i, j = np.arange(a, min(a + 64, len(node)))[:, None], np.arange(a + 1, len(node))[None, :]
            x, y = np.nonzero((now[i] != now[j]) & (i < j) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j])))
            x, y = x + a, y + a + 1
            tally = np.concatenate([np.zeros(0, np.int64), *((marks[x[c : c + 65536]] == marks[y[c : c + 65536]]).sum(axis=1) for c in range(0, len(x), 65536))])
            for k in np.argsort(-tally, kind="stable")[: int((tally >= enough).sum())]:
                u, v = int(x[k]), int(y[k])
                p, q = find(of[u]), find(of[v])
                if p == q:
                    continue
                both = in_both(hashes_of(u), hashes_of(v))
                if both >= least * (len(sets[u]) + len(sets[v]) - both):
                    root[max(p, q)] = min(p, q)
                    out.append((int(node[u]), int(node[v])))
        return out

    def run(batches):
        for table in whole_lists(batches, 3):
            band, key, part, node, component, size = (table.column(k).to_numpy() for k in range(6))
            marks = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint8).reshape(len(node), -1)
            hashes = table.column(7).to_pylist()
            new = np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            out = []
            for a, b in zip([0, *new], [*new, len(node)]):
                out += links_of(node[a:b], component[a:b], size[a:b], marks[a:b], hashes[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["src", "dst"])

    rows = in_parts(lists, ["band", "key"], BLOCK)
    return rows.select("band", "key", "part", "node", "component", "size", "marks", "hashes").mapInArrow(tidy(run), "src long, dst long")


def components(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, bits: int = BITS) -> DataFrame:
    """(text_hash, component) of every text: texts linked by chains of pairs with a similarity of ``least`` or more."""
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = materialize(signatures(texts, shingle), "signatures")
    prints = signed.where("size > 0").select("node", F.array("fp").alias("fps")).dropDuplicates(["node"])
    prints = materialize(simhash.links(prints, bits).distinct(), "print-links")
    classes = signed.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"))
    posted = classes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    lists = posted.groupBy("band", "key").agg(F.min(F.struct("node", "size")).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(posted.join(lists.select("band", "key", "first"), ["band", "key"]), "shared-keys")
    # sets whose sizes differ too much can't be alike
    near = F.least("size", "first.size") >= F.lit(least) * F.greatest("size", "first.size")
    tried = shared.where(F.col("node") != F.col("first.node")).where(near).select(F.col("first.node").alias("src"), F.col("node").alias("dst")).distinct()
    tried = materialize(tried.unionAll(prints).distinct(), "pairs")
    ends = shared.select("node").unionAll(prints.select("src")).unionAll(prints.select("dst")).distinct()
    places = signed.join(ends, "node").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    sets = materialize(shingle_sets(texts.join(places, "text_hash").select("node", "text").dropDuplicates(["node"]), shingle), "shingle-sets")
    found = materialize(alike(tried, sets, least), "links")
    release(spark)
    of = connected_components(found)
    grouped = shared.select("band", "key", "node", "size").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = grouped.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "key")
    marks = signed.where("size > 0").groupBy("node").agg(F.first("marks").alias("marks"))
    lists = materialize(grouped.join(mixed, ["band", "key"]).join(marks, "node"), "mixed-keys")
    both = materialize(found.unionAll(linked(lists.join(sets, "node"), least)), "links")
    drop(prints, shared, tried, lists, sets, found)
    release(spark)
    of = signed.select("text_hash", "node").distinct().join(connected_components(both), "node", "left")
    return of.select("text_hash", F.coalesce("component", "node").alias("component"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, and of these that of the smallest hash of its text."""
    return keep_one(docs, components(docs, text_col, shingle, least), id_col, text_col)
