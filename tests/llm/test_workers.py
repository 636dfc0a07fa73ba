"""What a Python worker holds from batch to batch, and how often it looks at a piece."""

import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from skillgrid.llm import bpe, decontaminate, langid, ragged, similar, simhash, token_store


def own_mb():
    """MB of this process that no file backs."""
    return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_memory_is_given_back():
    """Before every batch but the first, and after the last, next to nothing is held of the 190 MB that a batch took."""
    held, pins = [], []

    def run(batches):
        for batch in batches:
            held.append(own_mb())
            rows = [np.ones(12_000) for _ in range(2000)]
            pins.append(np.ones(12_000))  # taken last, so that the C library can't shorten its heap by itself
            assert own_mb() > held[-1] + 100
            del rows
            yield batch

    one = pa.record_batch({"k": [1]})
    assert len(list(ragged.tidy(run)(iter([one] * 3)))) == 3
    held.append(own_mb())
    assert max(held[1:]) < held[0] + 60


@pytest.mark.parametrize(
    "make",
    [
        lambda d: similar.signatures(d.selectExpr("doc_id as text_hash", "text")),
        lambda d: similar.shingle_sets(d.selectExpr("doc_id as node", "text")),
        lambda d: simhash.links(d.selectExpr("doc_id as node", "array(doc_id) as fps")),
        lambda d: langid.classify(d, {"en": b"some words", "de": b"andere"}),
        lambda d: decontaminate.scan(d.selectExpr("doc_id", "1L as text_hash", "text"), decontaminate.windows_of(d, [("a", "one")])),
        lambda d: token_store.token_ids(d, public_tokenizers.path("word_bpe_49k.json"), 1),
    ],
)
def test_steps_of_the_pipeline_give_memory_back(spark, docs, make, monkeypatch):
    used = []
    for module in (similar, simhash, langid, decontaminate, token_store):
        monkeypatch.setattr(module, "tidy", lambda run: used.append(run) or run)
    make(docs).collect()
    assert used


def test_every_piece_is_looked_up_once(monkeypatch):
    """One pass over the pieces finds their places and what is new; ids are the library's, with a full memory, too."""
    path = public_tokenizers.path("word_bpe_49k.json")
    passes = []

    class Pieces(list):
        def __iter__(self):
            passes.append(1)
            return super().__iter__()

    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, rng.integers(1, 12)))) for _ in range(400)]
    want, enc = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)], bpe.Encoder(path)
    for _ in range(2):
        ids, n, at = enc.piece_ids(Pieces([*texts, "\n", *texts]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [*want, [], *want] and at[400] == 0
    assert len(passes) == 2 and len(enc.known) == len({*texts}) + 1 == len(enc.starts) - 1
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    for a in range(0, 400, 40):
        ids, n, _ = enc.piece_ids(texts[a : a + 40] + texts[:10])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want[a : a + 40] + want[:10]
