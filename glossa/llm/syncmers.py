"""Document fingerprints from closed syncmers.

Of all k-byte substrings, those whose smallest s-byte substring lies at an edge are chosen: a choice
that needs no context, so equal passages give equal anchors wherever they stand. The fingerprint holds
all anchors of the text, repeats included, each with its place, and likeness counts the anchors that two
fingerprints share at one common offset (the best band of diagonals).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.runtime import lean, partitions, ship

LONG, SHORT, BAND = 20, 8, 64
RANGE, MOST_RANGES = 10_000, 20_000  # documents to a range, ranges at most: they only set the size of tasks
STEP, BLOCK = 1 << 17, 1 << 19  # bytes looked through at a time, bytes of text to a block: they only bound memory
_TABLE = K.mix(np.arange(901, 1157, dtype=np.uint64))
_LOW = -(1 << 63)


def _closed(data: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes (uint32) of the closed syncmers of at least k bytes, whatever texts they belong to."""
    n = len(data)
    v = _TABLE[data]
    small = v[: n - s + 1].copy()
    for i in range(1, s):
        small = small * np.uint64(0x9E3779B97F4A7C15) + v[i : n - s + 1 + i]
    small = K.mix(small) >> np.uint64(32)
    w = k - s + 1
    low, span = small, 1
    while span < w:
        step = min(span, w - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    at = np.flatnonzero((small[: n - k + 1] == low) | (small[w - 1 :] == low))
    # the k-byte substring is its s-byte parts at every s-th place and the last one
    h = np.zeros(len(at), np.uint64)
    for i in (*range(0, k - s, s), k - s):
        h = h * np.uint64(0xD6E8FEB86659FD93) + small[at + i]
    return at, (K.mix(h) >> np.uint64(32)).astype(np.uint32)


def anchors(data: np.ndarray, offs: np.ndarray, k: int = LONG, s: int = SHORT) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its fingerprint: hashes (uint32, ascending) and places (bytes, ascending among
    equal hashes) of all its anchors. A text without a closed syncmer (each of fewer than k bytes is one)
    has one anchor, the whole text; an empty text has none."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    size = np.diff(offs)
    parts = [_closed(data[i : i + STEP + k - 1], k, s) for i in range(0, len(data) - k + 1, STEP)]
    at = np.concatenate([np.zeros(0, np.int64), *(p + i * STEP for i, (p, _) in enumerate(parts))])
    h = np.concatenate([np.zeros(0, np.uint32), *(x for _, x in parts)])
    doc = np.searchsorted(offs, at, "right") - 1
    inside = at + k <= offs[doc + 1]
    doc, at, h = doc[inside], at[inside], h[inside]
    order = np.lexsort((at, h, doc))
    doc, at, h = doc[order], at[order], h[order]
    first = np.searchsorted(doc, np.arange(len(size) + 1))
    for i in range(len(size)):
        a, b = first[i], first[i + 1]
        if a < b:
            out.append((h[a:b], at[a:b] - offs[i]))
        elif size[i]:
            d = hashlib.sha256(data[offs[i] : offs[i + 1]].tobytes()).digest()
            out.append((np.frombuffer(d[:4], np.uint32), np.zeros(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint32), np.zeros(0, np.int64)))
    return out


def as_string(f: tuple[np.ndarray, np.ndarray]) -> str:
    """The anchors by place, in base 64: of each the hash (4 bytes, highest first) and the distance from the
    place before (7 bits a byte, lowest first, the top bit set where more follow)."""
    order = np.argsort(f[1], kind="stable")
    h, step = f[0][order].astype(">u4"), np.diff(f[1][order], prepend=0)
    more = 1 + sum((step >> 7 * i > 0).astype(np.int64) for i in range(1, 9))
    start = np.cumsum(more + 4) - more - 4
    raw = np.zeros(int((more + 4).sum()), np.uint8)
    raw[start[:, None] + np.arange(4)] = h.view(np.uint8).reshape(-1, 4)
    for i in range(int(more.max(initial=0))):
        has = more > i
        raw[start[has] + 4 + i] = (step[has] >> 7 * i & 127) | np.where(more[has] > i + 1, 128, 0)
    return base64.urlsafe_b64encode(raw.tobytes()).decode()


def _keys(h: np.ndarray, low: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)


def _rank(h: np.ndarray) -> np.ndarray:
    """How many equal ones stand before each of ascending h."""
    return np.arange(len(h)) - np.searchsorted(h, h, "left")


def _met(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], low: int, high: int) -> int:
    """How many anchors of a have an equal one in b from low to high bytes before their own place."""
    top = (1 << 32) - 1
    own = _keys(*b)
    first = np.searchsorted(own, _keys(a[0], np.clip(a[1] - high, 0, top)), "left")
    last = np.searchsorted(own, _keys(a[0], np.clip(a[1] - low, 0, top)), "right")
    return int(((last > first) & (a[1] >= low)).sum())


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], band: int = BAND) -> float:
    """Share of the two texts' anchors that stand in both at one offset (Dice), 0 to 1; 1 for two empty
    texts. Equal anchors vote for the band, the first of a text with the first of the other and so on, which
    keeps the work linear however often one repeats; all anchors within it are counted."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(_keys(a[0], _rank(a[0])), _keys(b[0], _rank(b[0])), assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    d, votes = np.unique((a[1][i] - b[1][j]) // band, return_counts=True)
    votes = votes + np.where(np.append(d[1:] == d[:-1] + 1, False), np.append(votes[1:], 0), 0)
    low = int(d[np.argmax(votes)]) * band
    high = low + 2 * band - 1
    return (_met(a, b, low, high) + _met(b, a, -high, -low)) / (len(a[0]) + len(b[0]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) -> (doc_id, n_chars long, edited_sha256, fingerprint,
    edited_fingerprint string, near_edited, near_next double), a row per row.

    The edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document by descending doc_id (null ids last, equal ids by a hash of the text); after the last
    comes the first. Null texts count as empty. Equal texts have equal fingerprints; an empty text's is
    ''. Long texts keep all their anchors, repeated rows are documents of their own, other columns are not
    read. Empty tables give empty results.

    Rows are dealt into ranges of doc_id; each range also gets a copy of the next range's first row, so
    neighbours meet without a global sort in one task. The driver holds a row for each range only."""
    spark = docs.sparkSession
    ship(spark)
    d = lean(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    place = d.withColumn("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)))
    n = max(partitions(spark), min(MOST_RANGES, place.count() // RANGE))
    cuts = place.approxQuantile("at", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = np.unique(np.array(cuts, np.float64)).astype(np.int64) if cuts else np.zeros(0, np.int64)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seg = len(bounds) - np.searchsorted(bounds, batch.column(0).to_numpy(), "left")
            yield pa.RecordBatch.from_arrays([pa.array(seg.astype(np.int32)), batch.column(0), batch.column(1)], ["seg", "at", "tie"])

    heads = place.select("at", "tie").mapInArrow(ranged, "seg int, at long, tie long").groupBy("seg").agg(F.max(F.struct("at", "tie")).alias("m")).orderBy("seg").collect()
    segs = [r.seg for r in heads]
    before = {(r.seg, r.m["at"], r.m["tie"]): segs[i - 1] for i, r in enumerate(heads)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in K.blocks(batches):
            at, tie = b.column("at").to_numpy(), b.column("tie").to_numpy()
            seg = len(bounds) - np.searchsorted(bounds, at, "left")
            body = [z.compress(b.raw(i)) for i in range(len(b))]
            more = [i for i in range(len(b)) if (int(seg[i]), int(at[i]), int(tie[i])) in before]
            take = np.array([*range(len(b)), *more])
            to = np.array([*seg, *(before[int(seg[i]), int(at[i]), int(tie[i])] for i in more)], np.int32)
            extra = np.arange(len(take)) >= len(b)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(extra), b.column("doc_id").take(pa.array(take)), pa.array(at[take]), pa.array(tie[take]), pa.array([body[i] for i in take], pa.binary())], ["seg", "extra", "doc_id", "at", "tie", "z"])

    kind = dict(d.dtypes)["doc_id"]
    dealt = place.select("doc_id", "at", "tie", "text").mapInArrow(deal, f"seg int, extra boolean, doc_id {kind}, at long, tie long, z binary")
    dealt = dealt.repartition(n, "seg").sortWithinPartitions("seg", "extra", F.desc("at"), F.desc("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        rows: list[tuple] = []
        n = 0
        for batch in batches:
            seg, extra, doc, body = (batch.column(batch.schema.get_field_index(c)) for c in ("seg", "extra", "doc_id", "z"))
            for i in range(batch.num_rows):
                rows.append((seg[i].as_py(), extra[i].as_py(), doc[i].as_py(), z.decompress(body[i].as_buffer())))
                n += len(rows[-1][3])
                if n >= BLOCK and len(rows) > 1:
                    yield _rows(rows, kind)
                    rows, n = rows[-1:], len(rows[-1][3])
        if len(rows) > 1:
            yield _rows(rows, kind)

    return dealt.select("seg", "extra", "doc_id", "z").mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _rows(rows: list[tuple], kind: str) -> pa.RecordBatch:
    """Rows of consecutive documents, for all but the last (and but for copies of a later range's first)."""
    own = [i for i in range(len(rows) - 1) if not rows[i][1]]
    texts = [r[3] for r in rows]
    chars, edited = [], []
    for i in own:
        t, nxt = texts[i].decode(), texts[i + 1].decode()
        half = len(t) // 2
        chars.append(len(t))
        edited.append((t[: len(t) - half] + nxt[:half]).encode())
    every = texts + edited
    offs = np.concatenate([[0], np.cumsum([len(t) for t in every])]).astype(np.int64)
    f = anchors(np.frombuffer(b"".join(every), np.uint8), offs)
    ef = f[len(texts) :]
    cols = [
        pa.array([rows[i][2] for i in own], pa.int64() if kind == "bigint" else None),
        pa.array(chars, pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array([as_string(f[i]) for i in own], pa.string()),
        pa.array([as_string(e) for e in ef], pa.string()),
        pa.array([likeness(f[i], e) for i, e in zip(own, ef, strict=True)], pa.float64()),
        pa.array([likeness(f[i], f[i + 1]) for i in own], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
