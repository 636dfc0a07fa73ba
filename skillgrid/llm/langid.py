"""Language identification by compression.

For every language a zstandard raw-content dictionary is cut from labelled texts. A text is compressed with
each of them, in pieces of ``PIECE`` bytes so that a long text doesn't learn its own language on the way, and the
language of the smallest total wins. The margin to the second smallest is the score; where it is narrow the text is rejected.
A text of less than ``SHORT`` bytes is compressed as repeats of itself: alone it would be stored as it is, at the same size for every language.

The dictionaries are fitted on a bounded sample of labelled rows: of each language about twice ``SAMPLE_DOCS``
documents, chosen by a hash of id and text, and ``DICT_BYTES`` of their text. Predictions read whole texts and nothing else.

Defined results: ``und`` with score 0 for a null text and for one without a letter; languages of equal size are
ordered by name; without labelled rows every text is ``und``; repeated rows stay; very long
texts are read whole, piece by piece; a null id is like any other; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.ragged import tidy
from skillgrid.session import drop, fresh, materialize

SAMPLE_DOCS, DICT_BYTES, PIECE, LEVEL, SHORT = 1500, 110_000, 1024, 6, 128

#: Every ASCII byte that isn't a letter becomes a space.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> bytes:
    """What is compressed: the words in lower case, one space between them."""
    return b" ".join(text.lower().encode().translate(LETTERS).split())


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _dictionary(rows: DataFrame, each: int, dict_bytes: int) -> dict[str, bytes]:
    """Stretches of ``each`` characters, from a place of the text that its key chooses, of rows (k, lang, text)."""
    at = (F.pmod(F.xxhash64("k", F.lit(1)), F.lit(1 << 30)) % F.greatest(F.length("text") - each + 1, F.lit(1))).cast("int") + 1
    out: dict[str, list] = {}
    for lang, k, t in rows.select("lang", "k", F.substring("text", at, F.lit(each))).collect():
        out.setdefault(lang, []).append((k, t))
    return {k: b" ".join(words_of(t) for _, t in sorted(v))[-dict_bytes:] or k.encode() for k, v in out.items()}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary for each language of the rows that aren't held out.

    Labels may be wrong, so one half of the sample judges the other: dictionaries of the first half classify the texts of the
    second, and those that get their own label make the dictionaries. Rows that are alike in id and text count once.
    """
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2 * sample_docs / n)))])
    u = F.pmod("k", F.lit(1 << 30)) / (1 << 30)
    each = max(64, dict_bytes // sample_docs * 4)
    sample = materialize(rows.where(u < share[F.col("lang")]).groupBy("k", "lang").agg(F.first("text").alias("text")), "lang-sample")
    first = F.pmod(F.xxhash64("k", F.lit(2)), F.lit(2)) == 0
    judges = {k: b"" for k in counts} | _dictionary(sample.where(first), each, dict_bytes)
    judged = classify(sample.where(~first), {k: v or k.encode() for k, v in judges.items()}, keep=sample.columns)
    found = {k: v or k.encode() for k, v in judges.items()} | _dictionary(judged.where(F.col("_lang") == F.col("lang")), each, dict_bytes)
    drop(sample)
    return found


def classify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("_lang", "_score")) -> DataFrame:
    """(doc_id, lang_pred, score), or the columns ``keep`` with the language and score added under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    known = sorted(dictionaries)
    out = ["doc_id", "lang_pred", "score"] if keep is None else [*keep, *names]

    def run(batches):
        import zstandard

        tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for k in known]
        for batch in batches:
            best, score = [], []
            for text in batch.column(batch.schema.get_field_index(text_col)):
                text = text.as_py()
                if not known or text is None or not any(map(str.isalpha, text)):
                    best.append("und")
                    score.append(0.0)
                    continue
                raw = words_of(text)
                if len(raw) < SHORT:
                    raw = b" ".join([raw] * (SHORT // (len(raw) + 1) + 1))
                pieces = [raw[a : a + PIECE] for a in range(0, len(raw), PIECE)]
                sizes = np.array([sum(len(tool.compress(p)) for p in pieces) for tool in tools])
                order = np.argsort(sizes, kind="stable")
                best.append(known[order[0]])
                score.append(1.0 - sizes[order[0]] / max(1, sizes[order[1]]) if len(known) > 1 else 1.0)
            found = [pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.columns if keep is not None else [batch.column(0)]), *found], out)

    kept = docs.select(F.col(id_col), F.col(text_col)) if keep is None else docs.select(*keep)
    kinds = [kept.schema[0].dataType.simpleString()] if keep is None else [f.dataType.simpleString() for f in kept.schema]
    return kept.mapInArrow(tidy(run), ", ".join(f"`{n}` {k}" for n, k in zip(out, [*kinds, "string", "double"])))


def keep_known(docs: DataFrame, dictionaries: dict[str, bytes], least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are rejected: no language, or a margin of ``least`` or less."""
    names = (fresh("lang_pred", docs.columns), fresh("score", docs.columns))
    out = classify(docs, dictionaries, id_col, text_col, docs.columns, names)
    return out.where((F.col(names[0]) != "und") & (F.col(names[1]) > least)).select(*docs.columns)
