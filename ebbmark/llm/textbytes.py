"""Texts of Arrow batches as one array of bytes, and words in it, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Bytes that follow every array of joined texts, so that eight can be read from any place.
PAD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gathered(batches: Iterator[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.Table]:
    """The batches joined to tables of some ``size`` bytes of ``column``; a longer text stands in one of its own."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        held += batch.column(column).nbytes
        if held >= size:
            yield pa.Table.from_batches(kept)
            kept, held = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): the UTF-8 texts each followed by a line break, and where each begins (one more at the end).

    A null counts as an empty text; PAD more bytes follow.
    """
    array = pc.fill_null(column, "").cast(pa.large_string()).combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(array) and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    starts = offsets + np.arange(len(offsets))
    out = np.full(len(raw) + len(array) + PAD, 10, np.uint8)
    keep = np.ones(len(raw) + len(array), bool)
    keep[starts[1:] - 1] = False
    out[: len(keep)][keep] = raw
    return out, starts


def eights(body: np.ndarray) -> np.ndarray:
    """View of the eight bytes from every place, little-endian."""
    return np.ndarray(len(body) - 7, "<u8", body, strides=(1,))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def hashed(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of body[start:end] for each word."""
    view, size = eights(body), (ends - starts).astype(np.uint64)
    out = mix(size + np.uint64(seed * int(_P) % 2**64))
    short = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(short):
        left = size[short] - np.uint64(at)
        x = view[starts[short] + at]
        part = left < 8
        x[part] &= (np.uint64(1) << (left[part] * np.uint64(8))) - np.uint64(1)
        out[short] = mix(out[short] * _P + x)
        at += 8
        short = short[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(body[starts[i] : ends[i]].tobytes(), seed)
    return out
