"""Token counts by a map-side lookup in two tiers.

The first tier is a compact table of frequent pre-tokens (runs without white space) and their numbers of tokens, broadcast to the
workers: those that are a 100,000th of all or more, so at most 100,000. Each task counts its own and no pre-token is shuffled, only the
tasks' short summaries. Misses are encoded by the worker's tokenizer, which remembers the pieces it has seen. The table decides speed alone,
never a count.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows stay; an empty table gives an
empty one; other columns, whatever their names, are not carried; very long texts are handled alone.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.bpe import encoder, runs_of
from skillgrid.llm.ragged import offsets_of, slices
from skillgrid.session import drop, materialize

#: The share of all pre-tokens that makes one frequent, and the counters of a task.
SHARE, TRACKED = 1e-5, 200_000
#: Words from which a slice of texts leaves out what it has once.
MANY = 100_000


def frequent_runs(docs: DataFrame, text_col: str = "text", share: float = SHARE, tracked: int = TRACKED, slice_bytes: int = 6_000_000) -> list[str]:
    """Pre-tokens that are at least ``share`` of all: at most ``1 / share`` of them, whatever the corpus.

    Every task counts what it reads, in at most ``tracked`` counters, and gives those with a quarter of that share of its own words; only
    these summaries are added up, by word, with no place where all of them meet.
    """

    def tally(batches):
        held, total = Counter(), 0
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                words = runs_of(pc.fill_null(part.column(0), ""))[0]
                total += len(words)
                short = words.filter(pc.less_equal(pc.binary_length(words), 64))
                found = short.value_counts()
                if len(words) >= MANY:  # once in so many is rare
                    found = found.filter(pc.greater(found.field(1), 1))
                held.update(dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist())))
                if len(held) > tracked:
                    held = Counter(dict(held.most_common(tracked // 2)))
        some = {w: n for w, n in held.items() if 4 * n >= share * total}
        yield pa.RecordBatch.from_arrays([pa.array([None, *some], pa.string()), pa.array([total, *some.values()], pa.int64())], ["w", "n"])

    counted = materialize(docs.select(F.col(text_col).alias("text")).mapInArrow(tally, "w string, n long"), "run-counts")
    total = counted.where("w is null").agg(F.sum("n")).first()[0] or 0
    best = counted.where("w is not null").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= share * total)
    found = best.select("w").toArrow()["w"].to_pylist()
    drop(counted)
    return found


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", frequent: list[str] | None = None, slice_bytes: int = 6_000_000) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row. ``tokenizer``: a .json file of tokenizers or a .model file of sentencepiece."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    by_run = tokenizer.endswith(".json") and encoder(tokenizer).by_run
    if by_run and frequent is None:
        frequent = frequent_runs(docs, text_col)
    table = None
    if by_run and frequent:
        keys = pa.array(sorted(set(frequent)), pa.string())
        table = (keys, np.diff(encoder(tokenizer).run_ids(keys)[1]).astype(np.int32))
    shared = spark.sparkContext.broadcast(table)

    def lengths(text: pa.Array) -> np.ndarray:
        enc = encoder(tokenizer)
        words, off = runs_of(text)
        coded = words.dictionary_encode()
        runs = coded.dictionary
        if shared.value is None:
            n = np.diff(enc.run_ids(runs)[1])
        else:
            keys, known = shared.value
            at = pc.index_in(runs, value_set=keys)
            missed = at.is_null().to_numpy(zero_copy_only=False)
            n = np.zeros(len(runs), np.int64)
            n[~missed] = known[at.drop_null().to_numpy()]
            n[missed] = np.diff(enc.run_ids(runs.filter(pa.array(missed)))[1])
        return np.diff(offsets_of(n[coded.indices.to_numpy()])[off])

    def pieces(text: pa.Array) -> np.ndarray:
        if tokenizer.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            return np.array([len(x) for x in model.encode(text.to_pylist(), num_threads=1)], np.int64)
        return encoder(tokenizer).texts(text)[1]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                text = pc.fill_null(part.column(1), "")
                n = lengths(text) if by_run else pieces(text)
                yield pa.RecordBatch.from_arrays([part.column(0), pc.cast(pc.binary_length(text), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
