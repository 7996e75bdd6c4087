"""Splitting text into pre-tokens with array operations, and a bounded store of their token ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import regex

from glossa.llm import kernels as K

SPACE, LETTER, NUMBER, OTHER = range(4)


@cache
def _classes() -> np.ndarray:
    """Class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 documents, and each one's place in data, with the end's."""
    if not (data >= 0x80).any():
        return data, np.arange(len(data) + 1)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), np.append(at, len(data))


def cut(data: np.ndarray, offs: np.ndarray, glue: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the pre-tokens of all documents and each document's first pre-token.

    Contractions ('s 't 're 've 'm 'll 'd), runs of letters, of numbers, of other signs. With glue, a
    blank before a run belongs to it and white space makes pre-tokens too (all but the last character of
    a run that something follows); without, each number stands alone and white space is dropped."""
    z = np.zeros(0, np.int64)
    if not len(data):
        return z, z, np.zeros(len(offs), np.int64)
    c, at = code_points(data, offs)
    begin = np.searchsorted(at, offs)
    n = len(c)
    kind = _classes()[c]
    doc = np.zeros(n + 1, bool)
    doc[begin] = True
    same = np.zeros(n, bool)  # as the character before
    same[1:] = (kind[1:] == kind[:-1]) & ~doc[1:n]
    start = ~same
    solid = kind != SPACE
    if glue:
        blank = np.zeros(n, bool)
        blank[1:] = (c[:-1] == 0x20) & ~doc[1:n]
        start &= ~(solid & blank)
        before = np.zeros(n, bool)  # white space right before something in the same document
        before[:-1] = ~solid[:-1] & solid[1:] & ~doc[1:n]
        start |= before
    else:
        start |= kind == NUMBER
    q = np.flatnonzero((c == 0x27) & start)
    if len(q):
        wide = np.concatenate([c, np.zeros(3, c.dtype)])
        stop = np.concatenate([doc, np.ones(3, bool)])
        c1, c2 = wide[q + 1], wide[q + 2]
        in1, in2 = ~stop[q + 1], ~stop[q + 1] & ~stop[q + 2]
        two = in1 & np.isin(c1, np.frombuffer(b"stmd", np.uint8))
        three = in2 & ((((c1 == 0x72) | (c1 == 0x76)) & (c2 == 0x65)) | ((c1 == 0x6C) & (c2 == 0x6C)))
        start[q[two | three] + 1] = False
        for hit, k in ((two, 2), (three, 3)):
            end = q[hit] + k
            start[end[end < n]] = True
    s = np.flatnonzero(start)
    e = np.append(s[1:], n)
    if not glue:
        keep = solid[s]
        s, e = s[keep], e[keep]
    return at[s], at[e], np.searchsorted(s, begin)


class Store:
    """Token ids of pre-tokens, found by a 64-bit hash of their bytes, which are compared too: of two
    pre-tokens with one hash the later one gets ids of its own each time. At most about `most` pre-tokens
    are kept from one group of blocks to the next; an older store is dropped as a whole."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 250_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.begin, self.text = np.zeros(1, np.int64), np.zeros(8, np.uint8)  # the bytes of all, and eight more

    def add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """hashes: distinct and unknown, each with its bytes."""
        ids, counts = self.encode(words)
        row = np.arange(len(counts)) + len(self.first) - 1
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(w) for w in words])])
        self.text = np.concatenate([self.text[:-8], np.frombuffer(b"".join(words), np.uint8), np.zeros(8, np.uint8)])
        known, rows = np.concatenate([self.known, hashes]), np.concatenate([self.row, row])
        order = np.argsort(known)
        self.known, self.row = known[order], rows[order]

    def extra(self, words: list[bytes]) -> np.ndarray:
        """Rows of words that can't be found by hash."""
        at = len(self.first) - 1
        known, rows = self.known, self.row
        self.add(np.zeros(len(words), np.uint64), words)
        self.known, self.row = known, rows
        return np.arange(at, at + len(words))

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(hashes), bool)
        i = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return self.known[i] != hashes

    def look(self, hashes: np.ndarray) -> np.ndarray:
        return self.row[np.searchsorted(self.known, hashes)]


def _unlike(b: K.Block, s: np.ndarray, e: np.ndarray, rows: np.ndarray, store: Store) -> np.ndarray:
    """Pre-tokens whose bytes are not those that the store has for them: compared eight bytes a step."""
    begin, length = store.begin, np.diff(store.begin)
    n = e - s
    bad = length[rows] != n
    x, y = (np.ndarray(len(v) - 7, "<u8", v, strides=(1,)) for v in (np.concatenate([b.data, np.zeros(8, np.uint8)]), store.text))
    for i in np.flatnonzero(~bad & (n > K.LONG_SPAN)):
        bad[i] = b.data[s[i] : e[i]].tobytes() != store.text[begin[rows[i]] : begin[rows[i] + 1]].tobytes()
    at, k = np.flatnonzero(~bad & (n <= K.LONG_SPAN)), 0
    while len(at):
        differ = (x[s[at] + k] ^ y[begin[rows[at]] + k]) & K.MASKS[np.minimum(n[at] - k, 8)] != 0
        bad[at[differ]] = True
        k += 8
        at = at[~differ & (n[at] > k)]
    return np.flatnonzero(bad)


def encode_blocks(blocks: list[K.Block], store: Store, glue: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Token ids of each block's documents, one after the other, and where each document's begin."""
    if len(store.first) > store.most:
        store.clear()
    parts, need = [], {}
    for b in blocks:
        s, e, first = cut(b.data, b.offs, glue)
        distinct, at, inverse = np.unique(K.span_hashes(b.data, s, e), return_index=True, return_inverse=True)
        parts.append((s, e, distinct, inverse, first))
        new = store.missing(distinct)
        for h, i in zip(distinct[new].tolist(), at[new].tolist(), strict=True):
            if h not in need:
                need[h] = b.data[s[i] : e[i]].tobytes()
    if need:
        store.add(np.array(list(need), np.uint64), list(need.values()))
    out = []
    for b, (s, e, distinct, inverse, first) in zip(blocks, parts, strict=True):
        row = store.look(distinct)[inverse] if len(distinct) else np.zeros(0, np.int64)
        if len(row) and len(bad := _unlike(b, s, e, row, store)):
            row[bad] = store.extra([b.data[s[i] : e[i]].tobytes() for i in bad])
        count = (store.first[1:] - store.first[:-1])[row]
        end = np.cumsum(count)
        total = int(end[-1]) if len(end) else 0
        src = np.repeat(store.first[row] - (end - count), count) + np.arange(total)
        out.append((store.ids[src], np.concatenate([[0], end])[first]))
    return out


def groups(blocks, size: int):
    """Lists of blocks of about so many bytes in all."""
    held, n = [], 0
    for b in blocks:
        held.append(b)
        n += len(b.data)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held
