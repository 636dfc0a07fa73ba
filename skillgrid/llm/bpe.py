"""Token ids of whole texts, worked out once for each distinct piece of a batch.

A tokenizer whose normalizer makes white space one space and whose pre-tokenizer drops it reads every
run of other characters by itself. So a batch is split at ASCII white space, each distinct run is
encoded once, and the ids of the texts are gathered from those. Runs whose characters lie in
``PLAIN`` are cut into pieces by the tokenizer's own pattern and only new pieces reach the library;
all other runs go through the whole tokenizer.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skillgrid.llm.ragged import gather, offsets_of

#: Fixed value: the pre-tokenizer pattern of the public lower-case BPE vocabulary, as its file gives it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Lower-case letters and numbers below U+0180, where lower-casing is one character to one and NFC changes nothing.
LETTERS, NUMBERS = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+|\n")
#: A run with any other character, or with the opening of a special string, isn't plain.
NOT_PLAIN = r"[^!-~\x{A1}-\x{12F}\x{131}-\x{17F}]|<\|"
#: Pieces a worker remembers; beyond that it keeps those that it has just met again.
REMEMBERED = 200_000


def byte_letters() -> dict[int, int]:
    """Byte-level BPE writes each byte as a printable character: printable ones as themselves, the others from U+0100 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in kept]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)} | {32: 32}


class Places(dict):
    """A place for each piece; one that is looked up for the first time gets the next place and is noted as new."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = place = len(self)
        self.new.append(piece)
        return place

    def take_new(self) -> list[str]:
        new, self.new = self.new, []
        return new


class Encoder:
    """Ids of texts by one tokenizer file; keeps what it has learned for later batches of the same worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        #: Whether the text can be cut at white space first.
        self.by_run = kinds == ["NFC", "Replace", "Lowercase"] and (pre[0].get("pattern") or {}).get("Regex") == WORD_PATTERN and pre[0].get("behavior") == "Removed"
        self.size = self.whole.get_vocab_size()
        if self.by_run:
            self.pieces = Tokenizer.from_file(path)
            self.pieces.normalizer = normalizers.Sequence([])
            self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        #: Place of each known piece; its ids are ``flat[starts[place]:starts[place + 1]]``. The mark between two runs is the first, without ids.
        self.known = Places({"\n": 0})
        self.flat, self.starts = array("I"), array("q", [0, 0])

    def keep(self, pieces: list[str]) -> None:
        """Forget all but some known pieces, or all if these are more than half of what is remembered."""
        known, flat, starts = self.known, np.array(self.flat, np.uint32), np.array(self.starts)
        self.forget()
        if 2 * len(pieces) <= REMEMBERED:
            pieces = [p for p in pieces if p != "\n"]
            ids, n = gather(flat, starts, np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces)))
            self.known.update(zip(pieces, range(1, len(pieces) + 1)))
            self.flat.extend(ids.tolist())
            self.starts.extend(offsets_of(n)[1:].tolist())

    def piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of plain pieces and marks, their numbers, and the places of the pieces."""
        if len(self.known) > REMEMBERED:
            self.keep([p for p in {*pieces} if p in self.known])
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        new = self.known.take_new()
        for a in range(0, len(new), 128):
            some = new[a : a + 128]
            done = self.pieces.encode(" ".join(some).encode().decode("latin-1").translate(self.letters), add_special_tokens=False)
            ends = np.searchsorted(np.array(done.word_ids), np.arange(1, len(some) + 1))
            self.starts.extend((ends + len(self.flat)).tolist())
            self.flat.extend(done.ids)
        return *gather(np.array(self.flat, np.uint32), np.array(self.starts), at), at

    def run_ids(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of distinct runs without ASCII white space."""
        odd = pc.match_substring_regex(runs, NOT_PLAIN).to_numpy(zero_copy_only=False)
        plain = runs.filter(pa.array(~odd))
        if len(plain):
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), "\n")[0].as_py()
            plain_ids, n, at = self.piece_ids(PIECES.findall(joined.lower() + "\n"))
            plain_len = np.diff(np.concatenate([[0], offsets_of(n)[np.flatnonzero(at == 0)]]))
        else:
            plain_ids, plain_len = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not odd.any():
            return plain_ids, offsets_of(plain_len)
        others = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch(runs.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        lengths = np.zeros(len(runs), np.int64)
        lengths[~odd], lengths[odd] = plain_len, [len(x) for x in others]
        off = offsets_of(lengths)
        out = np.zeros(off[-1], np.uint32)
        inside = np.repeat(odd, lengths)
        out[~inside] = plain_ids
        out[inside] = np.concatenate(others)
        return out, off

    def texts(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of each; a null counts as empty."""
        text = pc.fill_null(text, "")
        if not self.by_run:
            done = [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) for t in text.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *done]), np.array([len(x) for x in done], np.int64)
        words, word_off = runs_of(text)
        coded = words.dictionary_encode()
        flat, off = self.run_ids(coded.dictionary)
        ids, per_word = gather(flat, off, coded.indices.to_numpy())
        return ids, np.diff(offsets_of(per_word)[word_off])


def runs_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of other characters than ASCII white space, and where those of each text begin."""
    parts = pc.ascii_split_whitespace(text)
    words, off = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not full.all():  # the splitter gives empty strings at both ends of a text
        words = words.filter(pa.array(full))
        off = offsets_of(full)[off]
    return words, off


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]
