"""Words of whole Arrow text columns as numpy arrays, without a Python string for each word."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Key of the hash of a word, and the bytes up to which it is worked out with numpy.
KEY, LONG = np.uint64(0x9E3779B97F4A7C15), 512
#: Bytes of text that are worked on at once; a longer text makes a part of its own.
PART = 4 << 20


def trim() -> None:
    """Gives memory that is free back to the system: workers are kept for later tasks, and share a limit with the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with free memory given back when a task begins and ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from run(batches)
        trim()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the places where texts begin, with the end of the last; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column) or at is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def parts(column: pa.Array, most: int = PART) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, beginnings) of runs of texts that hold about `most` bytes."""
    data, at = utf8(column)
    k, n = 0, len(at) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(at, at[k] + most, "right")) - 1)
        yield k, data[at[k] : at[end]], at[k : end + 1] - at[k]
        k = end


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of the runs of True; no run crosses the beginning of a text."""
    if not len(inside):
        return (np.empty(0, np.int64),) * 3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = np.unique(at[:-1][at[:-1] < at[1:]])
    first[edge] = inside[edge]
    last[edge[edge > 0] - 1] = inside[edge[edge > 0] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(at, begin, "right") - 1


def eight(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte on top; short at the end."""
    w = np.zeros(len(x) + 8, np.uint64)
    w[: len(x)] = x
    for k in (1, 2, 4):
        w[:-k] = w[:-k] << np.uint64(8 * k) | w[k:]
        w[-k:] <<= np.uint64(8 * k)
    return w[: len(x)]


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, key: np.uint64 = KEY) -> np.ndarray:
    """A 64-bit hash of each data[begin:end]; spans must not be empty.

    Eight bytes at a time are taken in by a bijection that isn't linear, after the length; longer spans get a keyed digest.
    """
    if not len(begin):
        return np.empty(0, np.uint64)
    size = end - begin
    word, value = eight(data), mix(size.astype(np.uint64) * key)
    left = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        left = left[size[left] > k]
        if not len(left):
            break
        spare = np.maximum(8 - (size[left] - k), 0).astype(np.uint64)
        value[left] = mix((value[left] ^ (word[begin[left] + k] >> (spare * np.uint64(8)))) + key)
    for k in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(data[begin[k] : end[k]].tobytes(), digest_size=8, key=int(key).to_bytes(8, "little")).digest()
        value[k] = int.from_bytes(digest, "little")
    return value


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z made a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def place(texts: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, index of the first word) of each of `count` texts; texts: of each word, in order."""
    n = np.bincount(texts, minlength=count)
    return n, np.cumsum(n) - n
