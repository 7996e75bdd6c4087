"""NumPy kernels over blocks of Arrow text: words, hashes, windows. No Spark in here.

A block is a slice of an Arrow batch whose text is about BLOCK bytes (one longer document makes a
block of its own), so memory is bounded by the longest document and not by the partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 4 << 20
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_B = U(0x9E3779B97F4A7C15 | 1)
_C = U(0xD6E8FEB86659FD93)
_ONES = (1 << 64) - 1
MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [_ONES], U)
LONG_SPAN = 512


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a bijection on 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Block:
    """data: the bytes of all documents, one after the other; offs: where each begins, and the end."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, offs: np.ndarray):
        self.batch, self.data, self.offs = batch, data, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))


def text_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offs


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK) -> Iterator[Block]:
    for batch in batches:
        data, offs = text_parts(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1))
            yield Block(batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            i = j


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, for each document, its first word's index."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = offs[:-1][offs[:-1] < offs[1:]]
    first[at] = solid[at]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[offs[1:][offs[:-1] < offs[1:]] - 1] = solid[offs[1:][offs[:-1] < offs[1:]] - 1]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, offs)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z only."""
    return _LOWER[data]


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of data[s:e] for each span, whatever lies around it. Eight bytes a step go through a mixing
    function, so no family of texts collides by its structure (as sums of powers modulo 2^64 do); spans of
    more than LONG_SPAN bytes are hashed one at a time."""
    if not len(s):
        return np.zeros(0, U)
    n = e - s
    h = mix(n.astype(U) + U((seed + 1) * 0x2545F4914F6CDD1D & _ONES))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place
    at = np.flatnonzero((n > 0) & (n <= LONG_SPAN))
    k = 0
    while len(at):
        left = np.minimum(n[at] - k, 8)
        x = eights[s[at] + k] & MASKS[left]
        h[at] = mix((h[at] ^ x) * _B + U(k + 1))
        k += 8
        at = at[n[at] > k]
    for i in np.flatnonzero(n > LONG_SPAN):
        h[i] = mix(h[i : i + 1] ^ U(xxhash.xxh3_64_intdigest(data[s[i] : e[i]].tobytes(), seed)))[0]
    return h


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the items i..i+n-1 of h for each i up to len(h) - n: equal sequences, equal values. Blocks of
    doubling size are mixed pairwise, and those that n is made of joined from the left."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out, at, block, size = np.full(m, mix(np.array([n], U))[0], U), 0, h, 1
    while size <= n:
        if n & size:
            out = mix((out ^ block[at : at + m]) * _B + U(size))
            at += size
        block = mix(block[:-size] * _C + (block[size:] ^ (block[size:] >> U(29)))) if size * 2 <= n else block
        size *= 2
    return out


def leftmost_min(v: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost smallest value in v[i:i+w], for each i up to len(v)-w."""
    val, idx, span = v, np.arange(len(v)), 1
    while span < w:
        step = min(span, w - span)
        left, right = val[:-step], val[step:]
        take = left <= right
        val, idx = np.where(take, left, right), np.where(take, idx[:-step], idx[step:])
        span += step
    return idx


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
