"""Small helpers for ragged integer arrays inside tasks."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Start of each run, with the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``values[offsets[i]:offsets[i+1]]`` for every i of ``index``, end to end; and their lengths."""
    lengths = np.diff(offsets)[index]
    starts = offsets_of(lengths)
    at = np.arange(starts[-1], dtype=np.int64)
    at += np.repeat(offsets[index] - starts[:-1], lengths)
    return values[at], lengths


def release() -> None:
    """Give what was freed back to the system: Arrow's memory, and what numpy and Python took from the C library where that can do it (glibc)."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def tidy(run):
    """``run`` for ``mapInArrow``, where memory is given back before each batch and at the end: a worker lives on from task to task, and would hold the most that any took."""

    def each(batches):
        for batch in batches:
            release()
            yield batch

    def whole(batches):
        yield from run(each(batches))
        release()

    return whole


def slices(batch: pa.RecordBatch, column: str, most_bytes: int, tidy_each: bool = True):
    """Cut a batch into runs of rows of about ``most_bytes`` of text; a longer row comes alone. Memory is given back after each, or after the last only."""
    text = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
            if tidy_each or b == batch.num_rows:
                release()
