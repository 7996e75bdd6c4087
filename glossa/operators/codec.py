"""Entropy coders: arithmetic coding by mixed contexts or by integer counts, and rANS; bits in and out; and the
archive that holds a whole document.

The state of a coder is sequential within one stream, so a document's streams are coded by one Arrow
row; documents are coded in parallel. Cumulative tables are integers, so both sides agree exactly. Bits
that a step settles are put out together, which gives the same stream as putting them one by one."""

from __future__ import annotations

import json
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import phonetic, text, words
from glossa.functions.dims import POS_TAGS
from glossa.functions.morph import applied
from glossa.operators import lockstep, streams
from glossa.operators.structure import decoded_tags

WIDTH, SCALE = 32, 1 << 16
TOP, HALF, QUARTER = (1 << WIDTH) - 1, 1 << (WIDTH - 1), 1 << (WIDTH - 2)


class BitWriter:
    """Most significant bit first; the last byte is filled with zeros."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, bits: str, after: int = 0) -> None:
        """Bits, and after the first of them so many of the other kind."""
        self.parts.append(bits[0] + ("0" if bits[0] == "1" else "1") * after + bits[1:] if after else bits)

    def data(self) -> bytes:
        return packed_bits("".join(self.parts))


def packed_bits(bits: str) -> bytes:
    whole = bits + "0" * (-len(bits) % 8)
    return np.packbits(np.frombuffer(whole.encode(), np.uint8) - 48).tobytes()


def unpacked_bits(data: bytes) -> str:
    return (np.unpackbits(np.frombuffer(data, np.uint8)) + 48).tobytes().decode()


class BitReader:
    """Zeros past the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def get(self, k: int = 1) -> int:
        while self.n < k:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at, self.n = self.at + 1, self.n + 8
        self.n -= k
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out


Table = tuple[list, list[int]]  # symbols, cumulative counts from 0


def integer_table(p: dict, scale: int = SCALE) -> Table:
    """Counts of at least 1 that follow probabilities, symbols sorted."""
    symbols = sorted(p)
    total = sum(p.values()) or 1
    cum = [0]
    for s in symbols:
        cum.append(cum[-1] + max(1, round(p[s] / total * scale)))
    return symbols, cum


def count_table(counts: dict) -> Table:
    symbols = sorted(counts)
    cum = [0]
    for s in symbols:
        cum.append(cum[-1] + counts[s])
    return symbols, cum


def encode_ranges(ranges: Iterator[tuple[int, int, int]]) -> bytes:
    """Arithmetic code of (lowest, highest + 1, total) counts."""
    low, high, waiting, out = 0, TOP, 0, BitWriter()
    for a, b, total in ranges:
        span = high - low + 1
        low, high = low + span * a // total, low + span * b // total - 1
        k = WIDTH - (low ^ high).bit_length()
        if k:
            out.put(format(low >> (WIDTH - k), f"0{k}b"), waiting)
            waiting = 0
            low, high = low << k & TOP, high << k & TOP | (1 << k) - 1
        k = WIDTH - 1 - (~(low & ~high) & HALF - 1).bit_length()  # a low of 01.. against a high of 10..
        if k:
            waiting += k
            low, high = low << k & HALF - 1, high << k & HALF - 1 | HALF | (1 << k) - 1
    out.put("1" if low >= QUARTER else "0", waiting + 1)
    return out.data()


def decode_ranges(data: bytes, n: int, cumulative: Callable[[int], list[int]], put: Callable[[int], None]) -> None:
    """The inverse: cumulative(i) gives the counts for the i-th symbol, put takes its number."""
    bits = BitReader(data)
    low, high, code = 0, TOP, bits.get(WIDTH)
    for i in range(n):
        cum = cumulative(i)
        total, span = cum[-1], high - low + 1
        s = bisect_right(cum, ((code - low + 1) * total - 1) // span) - 1
        put(s)
        low, high = low + span * cum[s] // total, low + span * cum[s + 1] // total - 1
        k = WIDTH - (low ^ high).bit_length()
        if k:
            low, high, code = low << k & TOP, high << k & TOP | (1 << k) - 1, code << k & TOP | bits.get(k)
        k = WIDTH - 1 - (~(low & ~high) & HALF - 1).bit_length()
        if k:
            for _ in range(k):  # the second bit goes
                code = (code - QUARTER) << 1 | bits.get()
            low, high = low << k & HALF - 1, high << k & HALF - 1 | HALF | (1 << k) - 1


def encode(symbols: Sequence, table: Callable[[int], Table]) -> bytes:
    """Arithmetic code of symbols; table(i) may depend on symbols before i. A symbol that its table lacks
    raises KeyError."""

    def ranges() -> Iterator[tuple[int, int, int]]:
        for i, s in enumerate(symbols):
            names, cum = table(i)
            try:
                k = names.index(s)
            except ValueError:
                raise KeyError(s) from None
            yield cum[k], cum[k + 1], cum[-1]

    return encode_ranges(ranges())


def decode(data: bytes, n: int, table: Callable[[list], Table]) -> list:
    """The inverse: table(symbols so far)."""
    out: list = []
    now: list = []

    def cumulative(_: int) -> list[int]:
        now[:] = table(out)
        return now[1]

    decode_ranges(data, n, cumulative, lambda s: out.append(now[0][s]))
    return out


def encode_counts(symbols: np.ndarray, n_values: int) -> tuple[bytes, np.ndarray]:
    """Code of small whole numbers by their own counts, and the counts."""
    n = np.bincount(symbols, minlength=n_values)
    cum = np.append(0, np.cumsum(n))
    total = len(symbols)
    return encode_ranges((a, b, total) for a, b in zip(cum[symbols].tolist(), cum[symbols + 1].tolist(), strict=True)), n


def decode_counts(data: bytes, n: np.ndarray) -> np.ndarray:
    cum = np.append(0, np.cumsum(n)).tolist()
    out: list[int] = []
    decode_ranges(data, cum[-1], lambda _: cum, out.append)
    return np.array(out, np.int64)


def quantised(p: dict, total: int = 4096) -> dict:
    """Counts that add up to total (a power of two): rounded, 1 at least; what is missing goes to the most
    probable symbols, one each, what is too much comes off the least probable over 1 (of equal ones the smaller
    first), the rest off or on the most probable."""
    n = {s: max(1, round(v * total)) for s, v in p.items()}
    ranked = sorted(p, key=lambda s: (-p[s], s))
    gap = total - sum(n.values())
    for s in ranked if gap > 0 else sorted(p, key=lambda s: (p[s], s)):
        if not gap:
            break
        step = 1 if gap > 0 else -1
        if n[s] + step >= 1:
            n[s] += step
            gap -= step
    n[ranked[0]] += gap
    return n


def rans_encode(symbols: Sequence, p: dict, total: int = 4096) -> bytes:
    """rANS with an unbounded integer state, last symbol first."""
    names, cum = count_table(quantised(p, total))
    at = {s: i for i, s in enumerate(names)}
    x = total
    for s in reversed(symbols):
        a, f = cum[at[s]], cum[at[s] + 1] - cum[at[s]]
        x = x // f * total + a + x % f
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def rans_decode(data: bytes, n: int, p: dict, total: int = 4096) -> list:
    names, cum = count_table(quantised(p, total))
    x, out = int.from_bytes(data, "big"), []
    for _ in range(n):
        slot = x % total
        k = bisect_right(cum, slot) - 1
        x = (cum[k + 1] - cum[k]) * (x // total) + slot - cum[k]
        out.append(names[k])
    return out


def frequency_archive(counts: dict, payload: bytes) -> bytes:
    """Length of a JSON table (4 bytes), the table, the payload."""
    head = json.dumps({str(k): v for k, v in counts.items()}).encode()
    return len(head).to_bytes(4, "big") + head + payload


def read_archive(data: bytes) -> tuple[dict[str, int], bytes]:
    n = int.from_bytes(data[:4], "big")
    return json.loads(data[4 : 4 + n]), data[4 + n :]


class Contexts:
    """Integer tables of a document's class stream: one for each sentence's share, code, tag and class before,
    made alike at both ends from the layout and the model. rows: each symbol's first table (for class 0 before)."""

    def __init__(self, lay: streams.Layout, model: streams.Model, weights: tuple, by_huffman: bool = True):
        of = np.cumsum(lay.first) - 1
        n_sentences = int(of[-1]) + 1 if len(of) else 0
        each = streams.shares(lay, streams.book(lay.tags)) if by_huffman else np.full(n_sentences, 1 / max(1, model.n_tags))
        values, at = np.unique(each, return_inverse=True)
        size = streams.CODES * streams.TAGS
        key = np.concatenate([at[of] * size + lay.codes * streams.TAGS + lay.tags, at * size + streams.NO_TAG])
        keys, group = np.unique(key, return_inverse=True)
        rows = np.repeat(np.arange(len(keys)), streams.CLASSES)
        prev = np.tile(np.arange(streams.CLASSES), len(keys))
        p = model.mixed(prev, keys[rows] % size // streams.TAGS, keys[rows] % streams.TAGS, values[keys[rows] // size], weights)
        n = np.where(model.seen, np.maximum(1, np.rint(p * SCALE)), 0)
        self.cum = np.zeros((len(n), streams.CLASSES + 1), np.int32)
        np.cumsum(n, 1, out=self.cum[:, 1:])
        self.rows = (np.where(lay.inner, group[lay.token], group[len(of) + of[lay.token]]) * streams.CLASSES).astype(np.int32)


def encoded_contexts(parts: list[tuple[Contexts, np.ndarray]]) -> list[bytes]:
    """The codes of some documents' (contexts, classes)."""
    a, b, total = [], [], []
    for c, cls in parts:
        row = c.rows + np.append(0, cls[:-1])
        for out, k in ((a, cls), (b, cls + 1), (total, -1)):
            out.append(c.cum[row, k].astype(np.uint32))
    return lockstep.encode([len(x) for x in a], *(np.concatenate(x) for x in (a, b, total)))


def decoded_contexts(parts: list[tuple[Contexts, bytes]]) -> list[np.ndarray]:
    """The inverse: (contexts, code) -> classes."""
    sizes = [len(c.rows) for c, _ in parts]
    base = np.cumsum([0, *(len(c.cum) for c, _ in parts)])
    rows = np.concatenate([c.rows.astype(np.int64) + k for (c, _), k in zip(parts, base[:-1], strict=True)])
    out = lockstep.decode([d for _, d in parts], sizes, np.concatenate([c.cum for c, _ in parts]), rows, True)
    return np.split(out, np.cumsum(sizes)[:-1])


def encoded_counts(parts: list[np.ndarray]) -> list[tuple[bytes, np.ndarray]]:
    """encode_counts() of some streams of whole numbers, each with the counts of 0 to its largest."""
    n = [np.bincount(x) for x in parts]
    a, b = [], []
    for x, k in zip(parts, n, strict=True):
        cum = np.append(0, np.cumsum(k)).astype(np.uint32)
        a.append(cum[x])
        b.append(cum[1:][x])
    sizes = [len(x) for x in parts]
    return list(zip(lockstep.encode(sizes, np.concatenate(a), np.concatenate(b), np.repeat(np.array(sizes, np.uint32), sizes)), n, strict=True))


def decoded_counts(parts: list[tuple[bytes, np.ndarray]]) -> list[np.ndarray]:
    """decode_counts() of some codes with their counts."""
    sizes = [int(n.sum()) for _, n in parts]
    cum = np.zeros((len(parts), 1 + max(len(n) for _, n in parts)), np.int64)
    for row, (_, n) in zip(cum, parts, strict=True):
        np.cumsum(n, out=row[1 : len(n) + 1])
        row[len(n) + 1 :] = row[len(n)]
    out = lockstep.decode([d for d, _ in parts], sizes, cum, np.repeat(np.arange(len(parts)), sizes), False)
    return np.split(out, np.cumsum(sizes)[:-1])


def _trained(m: streams.Marked) -> tuple[streams.Model, tuple]:
    model = streams.Model(*m.counts())
    return model, streams.fold(streams.winners(m, model))


_TRIP = "n_symbols long, n_bytes long, ok boolean, near_ideal boolean"


def arithmetic_round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_symbols, n_bytes, ok, near_ideal): the class stream of each document with words, coded by
    mixed contexts, and decoded; near_ideal: whether the code is at most 2% and 64 bits longer than the
    model's code length, and not shorter by more."""

    def one(m: streams.Marked, *_) -> tuple:
        model, w = _trained(m)
        return Contexts(m, model, w), m.cls.astype(np.uint8), streams.bits(m, model, w, True)

    def many(parts: list[tuple]) -> list[tuple]:
        data = encoded_contexts([(c, cls.astype(np.int64)) for c, cls, _ in parts])
        back = decoded_contexts([(c, d) for (c, *_), d in zip(parts, data, strict=True)])
        return [(len(cls), len(d), bool((x == cls).all()), abs(8 * len(d) - ideal) <= 64 + 0.02 * ideal) for (_, cls, ideal), d, x in zip(parts, data, back, strict=True)]

    return streams.per_document(docs, _TRIP, one, many, True)


def counts_round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_symbols, n_bytes, ok, near_ideal): the same by the document's own integer counts."""

    def many(parts: list[np.ndarray]) -> list[tuple]:
        data = encoded_counts(parts)
        out = []
        for cls, (d, n), back in zip(parts, data, decoded_counts(data), strict=True):
            n = n[n > 0]
            ideal = float(-(n * np.log2(n / n.sum())).sum())
            out.append((len(cls), len(d), bool((back == cls).all()), abs(8 * len(d) - ideal) <= 64))
        return out

    return streams.per_document(docs, _TRIP, lambda m, *_: m.cls.astype(np.uint8), many, True)


def rans_round_trip(docs: DataFrame, piece: int = 4096) -> DataFrame:
    """(doc_id, n_symbols, n_bytes, ok, near_ideal): streams are cut into pieces of `piece` symbols, which are
    coded side by side; near_ideal: within 2 bytes a piece and 64 bits of what the quantised table gives."""

    def many(parts: list[np.ndarray]) -> list[tuple]:
        sizes = [len(s) for s in parts]
        tables = []
        for s in parts:
            n = np.bincount(s, minlength=streams.CLASSES).tolist()
            q = quantised({k: v / len(s) for k, v in enumerate(n) if v})
            tables.append([q.get(k, 0) for k in range(streams.CLASSES)])
        f = np.array(tables, np.int64)
        ideal = [-sum(k * np.log2(v / 4096) for k, v in zip(np.bincount(s, minlength=streams.CLASSES).tolist(), t, strict=True) if v) for s, t in zip(parts, tables, strict=True)]
        pieces = [-(-k // piece) for k in sizes]
        of = np.repeat(np.arange(len(parts)), pieces)
        lengths = np.array([min(piece, k - i) for k in sizes for i in range(0, k, piece)], np.int64)
        data = lockstep.rans_encode(lengths, np.concatenate(parts).astype(np.int64), f[of])
        back = np.split(lockstep.rans_decode(data, lengths, f[of]), np.cumsum(sizes)[:-1])
        size = np.bincount(of, [len(d) for d in data], len(parts)).astype(int).tolist()
        return [(k, n, bool((b == s).all()), bool(abs(8 * n - i) <= 64 + 16 * p)) for k, n, b, s, i, p in zip(sizes, size, back, parts, ideal, pieces, strict=True)]

    return streams.per_document(docs, _TRIP, lambda m, *_: m.cls.astype(np.uint8), many, True)


def vlq(values: Sequence[int]) -> bytes:
    """Whole numbers from 0 in base 128, highest digit first, the top bit set where more digits follow."""
    v = np.asarray(values, np.int64)
    n = np.ones(len(v), np.int64)
    for i in range(1, -(-int(v.max(initial=0)).bit_length() // 7)):
        n += v >> 7 * i > 0
    end = np.cumsum(n)
    out = np.zeros(int(n.sum()), np.uint8)
    for i in range(int(n.max(initial=0))):
        has = n > i
        out[end[has] - 1 - i] = v[has] >> 7 * i & 127 | (128 if i else 0)
    return out.tobytes()


def from_vlq(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    stop = np.flatnonzero(b < 128)
    if not len(stop):
        return np.zeros(0, np.int64)
    last = np.searchsorted(stop, np.arange(len(b)))
    return np.add.reduceat((b & 127) << 7 * (stop[last] - np.arange(len(b))), np.append(0, stop[:-1] + 1))


def zigzag(v: np.ndarray) -> np.ndarray:
    """Whole numbers as such from 0."""
    return np.where(v < 0, -2 * v - 1, 2 * v)


def from_zigzag(v: np.ndarray) -> np.ndarray:
    return np.where(v & 1, -(v + 1) // 2, v // 2)


def lz77(values: Sequence[int], longest: int = 255) -> list[int]:
    """Tag streams as (distance, length, next) triples: the longest earlier match that starts with the same
    three values, met last; distance 0 where there is none; next is -1 at the end."""
    out, i, n = [], 0, len(values)
    met: dict[tuple, int] = {}
    while i < n:
        at, k = met.get(tuple(values[i : i + 3]), -1), 0
        if at >= 0:
            while k < longest and i + k < n and values[at + k] == values[i + k]:
                k += 1
        out += [i - at if k else 0, k, values[i + k] if i + k < n else -1]
        for j in range(i, min(i + k + 1, n - 2)):
            met[tuple(values[j : j + 3])] = j
        i += k + 1
    return out


def from_lz77(triples: Sequence[int]) -> list[int]:
    out: list[int] = []
    for d, k, v in zip(triples[::3], triples[1::3], triples[2::3], strict=True):
        for _ in range(k):
            out.append(out[-d])
        if v >= 0:
            out.append(v)
    return out


def tag_round_trip(tags: DataFrame) -> DataFrame:
    """(doc_id, tags array<string>) -> (doc_id, n_tags, n_bytes, ok): tag numbers as triples in base 128, and back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {t: i for i, t in enumerate(POS_TAGS)}
        for b in batches:
            rows = []
            for d, ts in zip(b["doc_id"], b["tags"], strict=True):
                ids = [number[t] for t in ts]
                data = vlq(zigzag(np.array(lz77(ids), np.int64)))
                rows.append((d, len(ids), len(data), from_lz77(from_zigzag(from_vlq(data)).tolist()) == ids))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tags", "n_bytes", "ok"])

    return tags.select("doc_id", "tags").mapInPandas(run, "doc_id long, n_tags long, n_bytes long, ok boolean")


def _sparse(n: np.ndarray) -> bytes:
    at = np.flatnonzero(n)
    return vlq(np.concatenate([np.diff(at, prepend=0), n.reshape(-1)[at]]))


def _dense(data: bytes, shape: tuple) -> np.ndarray:
    v = from_vlq(data)
    out = np.zeros(int(np.prod(shape)), np.int64)
    out[np.cumsum(v[: len(v) // 2])] = v[len(v) // 2 :]
    return out.reshape(shape)


def sealed(sections: list[bytes], level: int = 19) -> bytes:
    """Sections (127 at most) in a zstd frame: their number, their lengths, and they themselves."""
    return zstandard.ZstdCompressor(level=level).compress(b"".join([vlq([len(sections), *map(len, sections)]), *sections]))


def opened(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, left = 1, raw[0]
    while left:
        left -= raw[at] < 128
        at += 1
    out = []
    for n in from_vlq(raw[1:at]).tolist():
        out.append(raw[at : at + n])
        at += n
    return out


def sections_of(m: streams.Marked, odd: dict[int, str], model: streams.Model, w: tuple) -> list[bytes | None]:
    """A document's words as sections: sentence and root lengths, codes, tag book and bits, the model's counts
    and weights, the counts of place deltas and both coded streams (these three are still to come), and words
    that rules don't give back."""
    tags, first = np.unique(m.tags, return_index=True)
    tags = tags[np.argsort(first)]
    book = streams.book(m.tags)
    return [
        vlq(np.bincount(np.cumsum(m.first) - 1) if len(m.first) else []), vlq(m.sizes), vlq(m.codes),
        vlq(np.stack([tags, np.bincount(m.tags, minlength=streams.TAGS)[tags]], 1).reshape(-1)), packed_bits("".join([book[t] for t in m.tags.tolist()])),
        *(_sparse(x) for x in m.counts()), struct.pack("<3d", *w), None, None, None,
        vlq(np.array(sorted(odd), np.int64)), "\n".join([odd[k] for k in sorted(odd)]).encode(),
    ]


def opened_layout(data: bytes) -> tuple:
    """An archive's layout, the contexts of its class stream, both coded streams with the counts of the second,
    codes and odd words."""
    lengths, sizes, codes, table, tag_bits, n1, n2, n3, w, n, classes, coded, keys, line = opened(data)
    per_sentence, sizes, codes = from_vlq(lengths), from_vlq(sizes), from_vlq(codes)
    sent = np.repeat(np.arange(len(per_sentence)), per_sentence)
    pairs = from_vlq(table).reshape(-1, 2)
    book = streams.book(np.repeat(pairs[:, 0], pairs[:, 1])) if len(pairs) else {}
    tags = np.array(decoded_tags(unpacked_bits(tag_bits), {k: v for k, v in book.items()})[: len(sizes)], np.int64)
    lay = streams.Layout(sent, sizes, codes, tags)
    model = streams.Model(_dense(n1, (streams.CLASSES,) * 2), _dense(n2, (streams.CODES, streams.CLASSES)), _dense(n3, (streams.TAGS, streams.CODES)))
    count = from_vlq(n)
    counts = _dense(n, (int(count[: len(count) // 2].sum()) + 1,))
    odd = dict(zip(from_vlq(keys).tolist(), line.decode().split("\n"), strict=False)) if keys else {}
    return lay, Contexts(lay, model, struct.unpack("<3d", w)) if len(lay) else None, classes, coded, counts, codes, odd


def unarchived(archives: list[bytes]) -> list[tuple[list[str], list[int], dict[int, str]]]:
    """Archives of some documents -> roots (without characters that have no coordinates), codes and odd words. The
    model is built from the counts alone, then the streams are decoded with it, all documents side by side."""
    parts = [opened_layout(x) for x in archives]
    full = [i for i, p in enumerate(parts) if len(p[0])]
    classes = dict(zip(full, decoded_contexts([(parts[i][1], parts[i][2]) for i in full]), strict=True)) if full else {}
    deltas = dict(zip(full, decoded_counts([(parts[i][3], parts[i][4]) for i in full]), strict=True)) if full else {}
    out = []
    for i, (lay, _, _, _, _, codes, odd) in enumerate(parts):
        if i not in classes:
            out.append(([""] * len(lay.sizes), codes.tolist(), odd))
            continue
        points = streams.characters()[classes[i], streams.places(from_zigzag(deltas[i]), lay.opens)]
        known = lay.inner & (points > 0)
        line, size = points[known].tobytes().decode("utf-32-le"), np.bincount(lay.token[known], minlength=len(lay.sizes))
        end = np.cumsum(size)
        out.append(([line[b - k : b] for k, b in zip(size.tolist(), end.tolist(), strict=True)], codes.tolist(), odd))
    return out


def known_only(root):
    """Without characters that have no coordinates: what a decoded stream gives."""
    return F.regexp_replace(root, phonetic.NOT_KNOWN, "")


def compressed(docs: DataFrame, more: str = "", also: Callable[[streams.Marked, streams.Share, object], tuple] = lambda *_: ()) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, archive binary, original_bytes, n_words, n_symbols, stream_bytes,
    archive_bytes long, stream_bits, bpb, payload_bpb, ratio, seconds double, error string): everything that
    decompressed() needs, and its sizes. A document that fails has its error and no archive; empty texts
    have null ratios. seconds: a document's own, and its share of the time in which streams are coded together.
    more, also: further columns (as in per_document) and what gives them for a document's streams and tokens."""
    import time

    def one(m: streams.Marked, share: streams.Share, t, size: int) -> tuple:
        began = time.perf_counter()
        try:
            model, w = _trained(m)
            got = sections_of(m, share.odd(t), model, w), Contexts(m, model, w), m.cls.astype(np.uint8), zigzag(m.deltas()).astype(np.uint16), streams.bits(m, model, w, True)
        except (ArithmeticError, LookupError, ValueError) as e:
            got = str(e)
        return got, size, len(m.sizes), time.perf_counter() - began, also(m, share, t)

    def many(parts: list[tuple]) -> list[tuple]:
        began = time.perf_counter()
        full = [i for i, (got, *_) in enumerate(parts) if not isinstance(got, str) and len(got[2])]
        failed: dict[int, str] = {}
        try:
            coded = _coded([parts[i][0] for i in full])
        except (ArithmeticError, LookupError, ValueError):  # one at a time, to find which
            coded = []
            for i in full:
                try:
                    coded += _coded([parts[i][0]])
                except (ArithmeticError, LookupError, ValueError) as e:
                    failed[i] = str(e)
                    coded.append(None)
        streams_of = dict(zip(full, coded, strict=True))
        each = (time.perf_counter() - began) / len(parts)
        out = []
        for i, (got, size, n_words, took, others) in enumerate(parts):
            began = time.perf_counter()
            error = got if isinstance(got, str) else failed.get(i)
            if error is not None:
                out.append((None, size, n_words, *[None] * 7, took + each, error, *others))
                continue
            sections, _, cls, _, bits = got
            a, (b, n) = streams_of.get(i) or _NOTHING
            sections[9:12] = _sparse(n), a, b
            data = sealed(sections)
            k = len(data)
            out.append((data, size, n_words, len(cls), len(a) + len(b), k, bits, *((bits / size, 8 * k / size, size / k) if size else (None,) * 3), took + each + time.perf_counter() - began, None, *others))
        return out

    kinds = "archive binary, original_bytes long, n_words long, n_symbols long, stream_bytes long, archive_bytes long, stream_bits double, bpb double, payload_bpb double, ratio double, seconds double, error string"
    return streams.per_document(docs, ", ".join(filter(None, (kinds, more))), one, many)


def _coded(parts: list[tuple]) -> list[tuple[bytes, tuple[bytes, np.ndarray]]]:
    """Both coded streams of some documents with symbols, and the counts of the second."""
    if not parts:
        return []
    return list(zip(encoded_contexts([(c, cls.astype(np.int64)) for _, c, cls, *_ in parts]), encoded_counts([p[3].astype(np.int64) for p in parts]), strict=True))


_NOTHING = encode_ranges(iter(())), (encode_ranges(iter(())), np.zeros(1, np.int64))


def payload_of(archives: DataFrame) -> DataFrame:
    """(doc_id, archive) -> (doc_id, roots, codes, exceptions) as payload() has them, and the column words where
    there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # of about the same length, as they are decoded side by side
        sizes: dict[int, int] = {}
        kind = None

        def flushed(k: int) -> pa.RecordBatch:
            sizes.pop(k)
            rows = held.pop(k)
            parts = unarchived([x for _, x, _ in rows])
            return pa.RecordBatch.from_arrays([pa.array([d for d, *_ in rows], kind), *([pa.array([w.as_py() for *_, w in rows], pa.list_(pa.string()))] if kept else []), pa.array([p[0] for p in parts], pa.list_(pa.string())), pa.array([p[1] for p in parts], pa.list_(pa.int32())), pa.array([list(p[2].items()) for p in parts], pa.map_(pa.int32(), pa.string()))], ["doc_id", *kept, "roots", "codes", "exceptions"])

        for batch in batches:
            kind = batch.column(0).type
            for d, x, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2) if kept else [None] * batch.num_rows, strict=True):
                k = len(x).bit_length()
                held.setdefault(k, []).append((d, x, w))
                sizes[k] = sizes.get(k, 0) + len(x) + 100
                if sizes[k] >= 500_000:
                    yield flushed(k)
                while sum(sizes.values()) >= 2_000_000:
                    yield flushed(max(sizes, key=sizes.__getitem__))
        if held:  # what is left goes together
            held, sizes = {0: [x for k in sorted(held) for x in held[k]]}, {0: 0}
            yield flushed(0)

    kept = ["words"] if "words" in archives.columns else []
    a = archives.select("doc_id", "archive", *kept).where("archive is not null")
    return a.mapInArrow(run, f"doc_id {dict(a.dtypes)['doc_id']}, {'words array<string>, ' * len(kept)}roots array<string>, codes array<int>, exceptions map<int,string>")


def decompressed(archives: DataFrame) -> DataFrame:
    """(doc_id, words, text) from the archives alone: streams decoded, roots inflected, words joined, the first
    letter capitalised and spacing repaired."""
    return rebuilt(payload_of(archives))


def full_decoded(coded: DataFrame) -> DataFrame:
    """(doc_id, state binary, n_symbols long, probabilities map<int,double>, lengths map<string,int>) ->
    (doc_id, text): one rANS stream that holds named streams one after the other, decoded to a sentence. Names
    in order: tree_shape_ids, sentence_meta, pos_deltas, morph_code_stream, char_class_deltas, char_pos_deltas,
    char_role_stream; lengths may lack some. Unknown coordinates give a question mark. The text is
    capitalised and ends as its first meta value says: 1 with ?, 3 with !, else with a full stop."""
    order = ("tree_shape_ids", "sentence_meta", "pos_deltas", "morph_code_stream", "char_class_deltas", "char_pos_deltas", "char_role_stream")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = streams.characters()
        for b in batches:
            out = []
            for d, state, n, p, lengths in b.itertuples(index=False):
                values = rans_decode(state, int(n), dict(p))
                named, at = {}, 0
                for name in order:
                    k = max(0, int(dict(lengths).get(name) or 0))
                    named[name], at = values[at : at + k], at + k
                cls, place = (np.cumsum(np.array(named[x], np.int64)) for x in ("char_class_deltas", "char_pos_deltas"))
                k = min(len(cls), len(place))
                line = "".join(chr(int(table[c, x]) or 63) if 0 <= c < streams.CLASSES and 0 <= x < 256 else "?" for c, x in zip(cls[:k].tolist(), place[:k].tolist(), strict=True))
                roots = split_roots(line)
                codes = (named["morph_code_stream"] + [0] * len(roots))[: len(roots)]
                out.append((d, roots, codes, int(named["sentence_meta"][0]) if named["sentence_meta"] else 0))
            yield pd.DataFrame(out, columns=["doc_id", "roots", "codes", "kind"])

    kind = dict(coded.dtypes)["doc_id"]
    rows = coded.select("doc_id", "state", "n_symbols", "probabilities", "lengths").mapInPandas(run, f"doc_id {kind}, roots array<string>, codes array<int>, kind int")
    line = text.capitalised(F.array_join(F.transform(F.arrays_zip("roots", "codes"), lambda x: applied(x["roots"], x["codes"])), " "))
    end = F.when((F.col("kind") == 1) & ~line.endswith("?"), "?").when((F.col("kind") == 3) & ~line.endswith("!"), "!").when(~line.rlike(r"[.?!]$"), ".").otherwise("")
    return rows.select("doc_id", F.when(line == "", "").otherwise(F.concat(line, end)).alias("text"))


def split_roots(line: str) -> list[str]:
    """Roots of a stream of characters: ^ starts one, $ ends it, _ is skipped, empty ones are dropped."""
    out, held = [], ""
    for c in line:
        if c == "^":
            held = ""
        elif c == "$":
            out, held = [*out, held] if held else out, ""
        elif c != "_":
            held += c
    return [*out, held] if held else out


def payload(docs: DataFrame, with_words: bool = False) -> DataFrame:
    """(doc_id, roots, codes, exceptions): what is needed to rebuild a document's words: roots, codes, and the
    surface wherever the rules don't give it back; with_words: also (words). One row a document with words;
    write it as Parquet or JSON."""

    def one(m: streams.Marked, share: streams.Share, t, _: int) -> tuple:
        n = share.word[t].tolist()
        roots, own = [share.roots[w] for w in n], [share.words[w] for w in n]
        codes = m.codes.tolist()
        odd = [(i, w) for i, (w, r, c) in enumerate(zip(own, roots, codes, strict=True)) if surface(r, c) != w]
        return (roots, codes, odd, own)[: 3 + with_words]

    return streams.per_document(docs, "roots array<string>, codes array<int>, exceptions map<int,string>" + ", words array<string>" * with_words, one, worded_only=True, nulls=True)


@lru_cache(100_000)
def surface(root: str, code: int) -> str:
    return words.applied(root, code)


def rebuilt(pay: DataFrame) -> DataFrame:
    """(doc_id, words, text): the inverse of payload, exact to the word; text is joined and repaired. Where pay has
    a column words, it comes along as given. Documents without words have no row."""
    given = "words" in pay.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                out = []
                for roots, codes, odd in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    ws = list(map(surface, roots, codes))
                    for i, w in odd or ():
                        ws[i] = w
                    out.append(ws)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string())), *batch.columns[4:]], ["doc_id", "words", *["given"] * given])

    p = pay.select("doc_id", "roots", "codes", "exceptions", *[F.col("words").alias("given")] * given).where(F.size("roots") > 0)
    back = p.mapInArrow(run, f"doc_id {dict(p.dtypes)['doc_id']}, words array<string>" + ", given array<string>" * given)
    return back.withColumn("text", text.autocorrected(text.capitalised(text.joined_words(F.col("words")))))


def words_returned(back: DataFrame) -> DataFrame:
    """rebuilt() with the words it was given -> (doc_id, n_words, ok): are they the same?"""
    return back.select("doc_id", F.size("words").alias("n_words"), (F.col("words") == F.col("given")).alias("ok")).where("doc_id is not null")
