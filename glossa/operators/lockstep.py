"""Many independent streams coded side by side: step i codes the i-th symbol of every stream that has one, as
NumPy operations over the streams. The bits are those of codec.encode_ranges and its inverse.

Streams are sorted by falling length, so those that a step still concerns stand in front; symbols lie step by
step. Where few streams are left, they are finished one at a time."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np

WIDTH = 32
TOP, HALF, QUARTER = (1 << WIDTH) - 1, 1 << (WIDTH - 1), 1 << (WIDTH - 2)
FEW = 16  # streams: from here on a loop over symbols costs less than a step
MOST = 1 << 29  # of a total, so that no symbol leaves a span of 1
_U = np.uint64
_TOP, _LOW, _WHOLE, _ONE, _EXPONENT, _FREE, _WIDTH, _LAST = (np.array([x], np.uint64) for x in (TOP, HALF - 1, 1 << WIDTH, 1, 52, 1022 + WIDTH, WIDTH, 63))


class Steps:
    """Order of streams, and where each step's symbols begin."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = np.asarray(sizes, np.int64)
        self.order = np.argsort(-self.sizes, kind="stable")
        self.rank = np.empty(len(self.order), np.int64)
        self.rank[self.order] = np.arange(len(self.order))
        longest = int(self.sizes.max(initial=0))
        self.width = len(self.sizes) - np.cumsum(np.bincount(self.sizes, minlength=longest + 1))[:longest]  # streams longer than i
        self.start = np.append(0, np.cumsum(self.width))

    def places(self) -> np.ndarray:
        """Where each symbol of the streams, one stream after the other, lies step by step."""
        begin = np.cumsum(self.sizes) - self.sizes
        stream = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return self.start[np.arange(len(stream)) - begin[stream]] + self.rank[stream]


def _narrowed(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Settled and pending bits shifted out: the new lower bound and span, and by how many bits. The span alone
    leaves two answers: with the larger shift, the upper bound may pass the top; then it is one less."""
    k = _FREE - ((span - _ONE).astype(np.float64).view(np.uint64) >> _EXPONENT)
    k -= ((low << k & _LOW) + (span << k)) > _WHOLE
    return low << k & _LOW, span << k, k


def _narrowed_one(low: int, span: int) -> tuple[int, int, int]:
    k = WIDTH - (span - 1).bit_length()
    if (low << k & HALF - 1) + (span << k) > 1 << WIDTH:
        k -= 1
    return low << k & HALF - 1, span << k, k


def encode(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray) -> list[bytes]:
    """Arithmetic codes of streams whose (lowest, highest + 1, total) counts stand one stream after the other.
    A code is the sum of what each symbol adds to the lower bound, at the place where it stood, so sums are made
    at the end, carries included."""
    s = Steps(sizes)
    n = len(s.sizes)
    at = s.places()
    ranges = np.empty((3, len(at)), np.uint32)
    for row, x in zip(ranges, (a, b, total), strict=True):
        row[at] = x
    if ranges[2].max(initial=0) > MOST:
        raise ValueError("too many symbols in one stream")
    added, place = np.zeros(len(at), np.uint32), np.zeros(len(at), np.int64)
    low, span, shift = np.zeros(n, np.uint64), np.full(n, 1 << WIDTH, np.uint64), np.zeros(n, np.uint64)
    steps = int(np.count_nonzero(s.width >= FEW))
    for x, m in zip(s.start[:steps].tolist(), s.width[:steps].tolist(), strict=True):
        y = x + m
        span_, total_ = span[:m], ranges[2, x:y]
        down = span_ * ranges[0, x:y] // total_
        up = span_ * ranges[1, x:y] // total_
        added[x:y], place[x:y] = down, shift[:m]
        low[:m], span[:m], k = _narrowed(low[:m] + down, up - down)
        shift[:m] += k
    for r in range(int(s.width[steps]) if steps < len(s.width) else 0):
        where = s.start[steps : int(s.sizes[s.order[r]])] + r
        lo, sp, sh = int(low[r]), int(span[r]), int(shift[r])
        downs, places = [], []
        for x, y, t in zip(*(v.tolist() for v in ranges[:, where]), strict=True):
            down = sp * x // t
            downs.append(down)
            places.append(sh)
            lo, sp, k = _narrowed_one(lo + down, sp * y // t - down)
            sh += k
        added[where], place[where] = downs, places
        low[r], span[r], shift[r] = lo, sp, sh
    # sums by 16 bits; a number at any bit covers three such words
    bits = shift.astype(np.int64) + WIDTH
    words = (bits + 15) // 16 + 1
    base = np.cumsum(words) - words
    rank = np.arange(len(at)) - np.repeat(s.start[:-1], s.width)
    word = base[rank] + (place >> 4)
    value = added.astype(np.int64) << 16 - (place & 15)
    size = int(words.sum()) + 2
    acc = sum(np.bincount(word + j, value >> (32 - 16 * j) & 0xFFFF, size) for j in range(3)).astype(np.int64)
    parts = [(acc >> 16 * j & 0xFFFF).astype(">u2") for j in range(3)]
    out: list[bytes] = [b""] * n
    for r, (x, m, k, lo) in enumerate(zip(base.tolist(), words.tolist(), bits.tolist(), low.tolist(), strict=True)):
        whole = 0
        for j, p in enumerate(parts):
            whole += int.from_bytes(p[x : x + m].tobytes(), "big") << 16 * j
        # less the lower bound, it ends in as many ones as bits are pending
        q = (whole >> 16 * m - k) - lo >> WIDTH - 1
        wt = (q ^ q + 1).bit_length() - 1
        end = 1 << wt + 1 if lo >= QUARTER else (1 << wt + 1) - 1
        k += 2 - WIDTH
        out[int(s.order[r])] = ((q >> wt + 1 << wt + 2 | end) << -k % 8).to_bytes((k + 7) // 8, "big")
    return out


def decode(data: Sequence[bytes], sizes: np.ndarray, cum: np.ndarray, rows: np.ndarray, follows: bool) -> np.ndarray:
    """The inverse: symbols, one stream after the other. cum: rows of cumulative counts from 0 (the last is the
    total); rows: each symbol's row; follows: to which the symbol before it (0 at first) is added."""
    s = Steps(sizes)
    n = len(s.sizes)
    at = s.places()
    row = np.empty(len(at), np.int64)
    row[at] = rows
    out = np.zeros(len(at), np.int64)
    wide = cum.shape[1] > 16
    # 64 bits from each byte on; zeros past a stream's end
    length = np.array([len(data[i]) for i in s.order], np.int64)
    base = np.cumsum(length + 16) - length - 16
    buf = np.frombuffer(b"".join([data[i] + bytes(16) for i in s.order]) + bytes(8), np.uint8)
    window = np.zeros(max(0, len(buf) - 8), np.uint64)
    for j in range(8):
        window |= buf[j : j + len(window)].astype(np.uint64) << _U(56 - 8 * j)
    last = base + length + 7
    ahead = window[base] >> _WIDTH if n else np.zeros(0, np.uint64)  # the code less the lower bound
    low, span = np.zeros(n, np.uint64), np.full(n, 1 << WIDTH, np.uint64)
    used, before = np.full(n, WIDTH, np.int64), np.zeros(n, np.int64)
    columns = cum.shape[1]
    flat = np.ascontiguousarray(cum).ravel()
    keys = (cum.astype(np.uint64) + (np.arange(len(cum), dtype=np.uint64) << _WIDTH)[:, None]).ravel() if wide else None
    steps = int(np.count_nonzero(s.width >= FEW))
    for x, m in zip(s.start[:steps].tolist(), s.width[:steps].tolist(), strict=True):
        r = row[x : x + m]
        if follows:
            r = r + before[:m]
        span_ = span[:m]
        first = r * columns
        total = flat[first + (columns - 1)].astype(np.uint64)
        v = ((ahead[:m] + _ONE) * total - _ONE) // span_
        if wide:
            found = np.searchsorted(keys, v + (r.astype(np.uint64) << _WIDTH), "right") - 1 - first
        else:
            found = np.add.reduce(cum[r, 1:-1] <= v.astype(cum.dtype)[:, None], axis=1, dtype=np.int64)
        first += found
        down = span_ * flat[first].astype(np.uint64) // total
        up = span_ * flat[first + 1].astype(np.uint64) // total
        out[x : x + m] = before[:m] = found
        low[:m], span[:m], k = _narrowed(low[:m] + down, up - down)
        u = used[:m]
        fresh = window[np.minimum(base[:m] + (u >> 3), last[:m])] << (u & 7).view(np.uint64) >> _ONE >> _LAST - k
        ahead[:m] = ahead[:m] - down << k | fresh
        u += k.view(np.int64)
    for r in range(int(s.width[steps]) if steps < len(s.width) else 0):
        where = s.start[steps : int(s.sizes[s.order[r]])] + r
        out[where] = _finished(row[where].tolist(), cum, follows, int(before[r]), int(low[r]), int(span[r]), int(ahead[r]), int(used[r]), data[s.order[r]])
    return out[at]


def _finished(rows: list[int], cum: np.ndarray, follows: bool, before: int, low: int, span: int, ahead: int, used: int, data: bytes) -> list[int]:
    """The rest of one stream."""
    data = data + bytes(16)
    tables: dict[int, list[int]] = {}
    got = []
    for r in rows:
        r += before if follows else 0
        t = tables.get(r)
        if t is None:
            t = tables[r] = cum[r].tolist()
        total = t[-1]
        before = bisect_right(t, ((ahead + 1) * total - 1) // span) - 1
        got.append(before)
        down = span * t[before] // total
        low, span, k = _narrowed_one(low + down, span * t[before + 1] // total - down)
        fresh = int.from_bytes(data[used >> 3 : (used >> 3) + 8], "big") >> 64 - (used & 7) - k & (1 << k) - 1 if k else 0
        ahead = ahead - down << k | fresh
        used += k
    return got


_M, _BITS = 4096, 12


def rans_encode(sizes: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """rANS codes of streams that stand one after the other, last symbol first; counts: a row a stream, adding up to
    4096. States start at 4096 and hand 32 bits on before they would pass 64; a code is the last state, then
    what was handed on, last first."""
    s = Steps(sizes)
    n = len(s.sizes)
    at = s.places()
    line = np.empty(len(at), np.int64)
    line[at] = symbols
    f = counts[s.order].astype(np.uint64)
    cum = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(f, 1, dtype=np.uint64)], 1)
    x = np.full(n, _M, np.uint64)
    given: list[tuple[np.ndarray, np.ndarray]] = []
    every = np.arange(n)
    for begin, m in zip(s.start[-2::-1].tolist(), s.width[::-1].tolist(), strict=True):
        k, state = line[begin : begin + m], x[:m]
        own = f[every[:m], k]
        over = np.flatnonzero(state >= own << _U(64 - _BITS))
        if len(over):
            given.append((over, state[over] & _TOP))
            state[over] >>= _WIDTH
        div = state // own
        x[:m] = (div << _U(_BITS)) + cum[every[:m], k] + (state - div * own)
    who = np.concatenate([w for w, _ in given]) if given else np.zeros(0, np.int64)
    what = np.concatenate([v for _, v in given]) if given else np.zeros(0, np.uint64)
    by = np.argsort(who, kind="stable")
    end = np.cumsum(np.bincount(who, minlength=n))
    what = what[by].astype(">u4")
    out: list[bytes] = [b""] * n
    for r, (state, e, b) in enumerate(zip(x.tolist(), end.tolist(), [0, *end.tolist()[:-1]], strict=True)):
        out[int(s.order[r])] = state.to_bytes((state.bit_length() + 7) // 8, "big") + what[b:e][::-1].tobytes()
    return out


def rans_decode(data: Sequence[bytes], sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The inverse. A state has 5 to 8 bytes where anything was handed on, as it is 2 to the 32nd at least then."""
    s = Steps(sizes)
    n = len(s.sizes)
    f = counts[s.order].astype(np.uint64)
    cum = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(f, 1, dtype=np.uint64)], 1)
    mine = [data[i] for i in s.order]
    head = [len(d) if len(d) <= 8 else 5 + (len(d) - 5) % 4 for d in mine]
    x = np.array([int.from_bytes(d[:h], "big") for d, h in zip(mine, head, strict=True)], np.uint64)
    left = np.array([(len(d) - h) // 4 for d, h in zip(mine, head, strict=True)], np.int64)
    words = np.frombuffer(b"".join([d[h:] for d, h in zip(mine, head, strict=True)]), ">u4").astype(np.uint64)
    next_ = np.cumsum(left) - left
    last = next_ + left
    out = np.empty(int(s.sizes.sum()), np.int64)
    every = np.arange(n)
    for begin, m in zip(s.start[:-1].tolist(), s.width.tolist(), strict=True):
        state = x[:m]
        slot = state & _U(_M - 1)
        k = np.count_nonzero(cum[:m, 1:-1] <= slot[:, None], 1)
        state = f[every[:m], k] * (state >> _U(_BITS)) + slot - cum[every[:m], k]
        low = np.flatnonzero((state <= _TOP) & (next_[:m] < last[:m]))
        if len(low):
            state[low] = state[low] << _WIDTH | words[next_[low]]
            next_[low] += 1
        x[:m] = state
        out[begin : begin + m] = k
    return out[s.places()]
