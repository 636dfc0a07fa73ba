"""Ranked lexical search, term at a time with limited accumulators.

Terms are runs of letters, digits and non-ASCII characters, A-Z in lower case. Every task holds shards of the documents' postings and works
through each item's terms there, rarest first by the number of documents in the whole corpus:

* while a document that has no accumulator yet could still come among the best ``k``, a term makes accumulators for all documents that hold it;
* once the bounds of the remaining terms together are below the ``k``-th partial score (of this shard, or of one that the task has done before), no
  accumulator is made any more: what has none can't reach the best, not even by a tie;
* those that exist are updated with all remaining terms, so that their scores are exact.

Each shard gives its best ``k`` for every item, and the best of those are the best of all. Postings don't move: what is shuffled are ``k`` rows for each
item and shard at most.

Corpus statistics (documents, their terms, documents that hold a term) come from all documents. The index has the terms of the items only, with their counts
in every document. Items are broadcast in blocks of ``BLOCK_BYTES`` of text; one longer item goes alone. Several blocks take as many passes.

Scores are 64-bit integers, see ``weight`` and ``impact``.

Defined results: a null text has no terms; a null item text has no rows; rows of documents count each by itself, also where they share an id; a null id comes after all others in
ties; items are told apart by id and text; documents that hold none of an item's terms, or only terms of weight 0, have score 0 and aren't returned; an empty table of either kind gives no rows; other columns,
whatever their names, are not carried; very long texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.llm.bpe import runs_of
from skillgrid.llm.decontaminate import fold
from skillgrid.llm.ragged import offsets_of, slices
from skillgrid.session import drop, materialize

#: Most bytes of the items of one pass, on average.
BLOCK_BYTES = 16 << 20
#: Documents and postings of a shard, at which it is searched.
SHARD_DOCS, SHARD_POSTINGS = 65_536, 4_000_000


def weight(n_docs: int, df: int) -> int:
    """A term's weight, from the documents with terms and those that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count adds, a billionth part at a time: 10^9 tf div (1000 tf + 8 m), where m is 25 and 75 parts of a document's length over the mean."""
    m = 25 + (75 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Items:
    """The terms of a block of items: distinct terms, and for each item its terms with how often it has them."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        self.ids = ids
        words, off = runs_of(fold(texts))
        coded = words.dictionary_encode()
        self.terms, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.of = [np.unique(codes[a:b], return_counts=True) for a, b in zip(off, off[1:])]

    def weigh(self, df: dict[int, int], n_docs: int, n_terms: int) -> None:
        """With the corpus's counts: weights, and each item's terms rarest first."""
        self.n_docs, self.n_terms = n_docs, n_terms
        count = np.array([df.get(t, 0) for t in range(len(self.terms))], np.int64)
        self.weights = np.array([weight(n_docs, int(c)) if c else 0 for c in count], np.int64)
        ordered = []
        for terms, repeats in self.of:
            some = self.weights[terms] > 0
            terms, repeats = terms[some], repeats[some]
            order = np.lexsort((terms, count[terms]))
            ordered.append((terms[order], repeats[order]))
        self.of = ordered


def index_terms(docs: DataFrame, terms: pa.Array, slice_bytes: int) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term: how many terms it has, and which of ``terms`` how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                words, off = runs_of(fold(part.column(1)))
                n = np.diff(off)
                code = pc.index_in(words, value_set=shared.value)
                known = code.is_valid().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(n)), n)[known]
                pair, tf = np.unique(of * max(1, len(shared.value)) + code.drop_null().to_numpy(), return_counts=True)
                of, term = np.divmod(pair, max(1, len(shared.value)))
                at = pa.array(offsets_of(np.bincount(of, minlength=len(n))), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (term, tf)]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tf array<int>")


class Shard:
    """Posting lists of some documents, by term; documents are numbered in order of their ids."""

    def __init__(self, batches: list[pa.RecordBatch], items: Items):
        table = pa.Table.from_batches(batches).combine_chunks()
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")]))
        self.ids, self.size = table["doc_id"].combine_chunks(), table.num_rows
        lists = table["terms"].combine_chunks()
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = table["tf"].combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(self.size), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(term, kind="stable")
        self.docs = doc[order]
        self.impacts = impact(tf[order], table["n"].to_numpy()[self.docs], items.n_docs, items.n_terms)
        self.off = offsets_of(np.bincount(term, minlength=len(items.terms)))
        self.most = np.zeros(len(items.terms), np.int64)
        held = np.flatnonzero(np.diff(self.off))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impacts, self.off[held])
        self.score = np.zeros(self.size, np.int64)

    def best(self, terms: np.ndarray, gains: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` documents and their scores. ``gains``: weight times repeats; ``least``: a score that k documents elsewhere have."""
        score = self.score
        bounds = gains * self.most[terms]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        at, highest = 0, 0
        for at in range(len(terms) + 1):
            if rest[at] < max(least, highest):
                found = score[score > 0]
                kth = np.partition(found, -k)[-k] if len(found) >= k else 0
                if rest[at] < max(kth, least):
                    break
            if at == len(terms):
                break
            a, b = self.off[terms[at]], self.off[terms[at] + 1]
            if b > a:
                score[self.docs[a:b]] += gains[at] * self.impacts[a:b]
                highest = max(highest, int(score[self.docs[a:b]].max()))
        held = np.flatnonzero(score)
        exact = score[held]
        score[held] = 0
        for t, gain in zip(terms[at:], gains[at:]):
            docs, impacts = self.docs[self.off[t] : self.off[t + 1]], self.impacts[self.off[t] : self.off[t + 1]]
            if len(docs) and len(held):
                there = np.minimum(np.searchsorted(docs, held), len(docs) - 1)
                exact += np.where(docs[there] == held, gain * impacts[there], 0)
        if len(held) > k:
            some = exact >= np.partition(exact, -k)[-k]
            held, exact = held[some], exact[some]
        order = np.lexsort((held, -exact))[:k]
        return held[order], exact[order]


def best_of_shards(index: DataFrame, items: Items, k: int, shard_docs: int, shard_postings: int) -> DataFrame:
    """(item, doc_id, score): the best ``k`` of every shard for every item, by the item's number."""
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        items = shared.value
        least = np.zeros(len(items.of), np.int64)

        def searched(held):
            shard = Shard(held, items)
            numbers, places, scores = [], [], []
            for i, (terms, repeats) in enumerate(items.of):
                docs, score = shard.best(terms, items.weights[terms] * repeats, k, int(least[i]))
                if len(docs) == k:
                    least[i] = max(least[i], score[-1])
                numbers.append(np.full(len(docs), i, np.int32))
                places.append(docs)
                scores.append(score)
            flat = [np.concatenate(x) for x in (numbers, places, scores)]
            return pa.RecordBatch.from_arrays([pa.array(flat[0]), shard.ids.take(pa.array(flat[1])), pa.array(flat[2])], ["item", "doc_id", "score"])

        held, docs, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            docs += batch.num_rows
            postings += len(batch.column(2).flatten())
            if docs >= shard_docs or postings >= shard_postings:
                yield searched(held)
                held, docs, postings = [], 0, 0
        if docs:
            yield searched(held)

    kind = index.schema["doc_id"].dataType.simpleString()
    return index.select("doc_id", "n", "terms", "tf").mapInArrow(run, f"item int, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS, slice_bytes: int = 4_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``k`` documents of every item, equal scores by ascending id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    name = f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score long"
    found = None
    for block in range(blocks):
        some = asked.where(F.col("block") == block).select("item_id", "text").toArrow().combine_chunks()
        if not some.num_rows:
            continue
        table = Items(some["item_id"].combine_chunks(), some["text"].combine_chunks())
        index = materialize(index_terms(rows, table.terms, slice_bytes), "lexical-index")
        n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            drop(index)
            break
        df = index.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # of the block's terms
        table.weigh(dict(map(tuple, df)), n_docs, n_terms)
        first = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = best_of_shards(index, table, k, shard_docs, shard_postings).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(table.ids), dtype=np.int32)), "item_id": table.ids}))
        part = materialize(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "lexical-best")
        drop(index)
        found = part if found is None else found.unionAll(part)
    return spark.createDataFrame([], name) if found is None else found
