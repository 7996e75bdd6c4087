"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is read as segments of 23, 23 and 18 bits. The perfect Golay code [23,12,7] puts
every 23-bit word within 3 bits of exactly one codeword; a word's keys are all codewords within 4 bits
(one or six of them), and two words that differ in at most 2 bits always share a key. How three wrong
bits can lie in the segments decides what else must be equal, and every key takes that along, so that
keys have 31 bits or more and rows seldom meet by chance:

last segment right, at most 2 in each other   both others' codewords and the last segment
all three in one 23-bit segment               the two other segments
last wrong, one other right                   that one and the other's codewords
one in each segment                           a right half of each (8 choices)

Rows with a common key are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.buckets import compare, forest, pairs_by_offset
from glossa.llm.graph import components
from glossa.llm.runtime import lean, partitions, row_key, ship, written

NEAR, SHINGLE = 3, 3
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the Golay code's generator
_M23 = (1 << 23) - 1


@cache
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """For each 11-bit syndrome, the error pattern of weight 3 at most and, for weight 3, the five
    others of weight 4, as 23-bit masks (repeated where there is only one)."""
    bits = [1 << i for i in range(23)]
    first = np.zeros(2048, np.int64)
    more: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        stack = [(0, 0, 0)]
        while stack:
            mask, n, start = stack.pop()
            if n == weight:
                syn = int(_syndrome(np.array([mask]))[0])
                if weight < 4:
                    first[syn] = mask
                else:
                    more[syn].append(mask)
                continue
            stack += [(mask | bits[i], n + 1, i + 1) for i in range(start, 23)]
    every = np.array([[f, *m[:5], *[f] * (5 - len(m[:5]))] for f, m in zip(first.tolist(), more, strict=True)], np.int64)
    assert all(len(m) in (0, 5) for m in more)
    return first, every


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of the division by the generator polynomial."""
    r = x.astype(np.int64).copy()
    for i in range(22, 10, -1):
        r ^= np.where(r >> i & 1, _GENERATOR << (i - 11), 0)
    return r


def _nearby(x: np.ndarray) -> np.ndarray:
    """n x 6 codeword indices (12 bits) within 4 bits of the 23-bit words x; repeats where there is one."""
    _, every = _decoder()
    return (x[:, None] ^ every[_syndrome(x)]) >> 11


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distinct keys for fingerprints (uint64)."""
    f = fp.astype(np.uint64)
    s0, s1, s2 = ((f >> np.uint64(a)) & np.uint64(m) for a, m in ((0, _M23), (23, _M23), (46, (1 << 18) - 1)))
    s0, s1, s2 = (s.astype(np.int64) for s in (s0, s1, s2))
    n0, n1 = _nearby(s0), _nearby(s1)
    halves = [[s & ((1 << n) - 1), s >> n | 1 << 12] for s, n in ((s0, 12), (s1, 12), (s2, 9))]
    k = [
        ((n0[:, :, None] << 12 | n1[:, None, :]) << 18 | s2[:, None, None]).reshape(len(f), 36),
        np.stack([s1 | s2 << 23 | 1 << 58, s0 | s2 << 23 | 2 << 58], 1),
        s0[:, None] << 12 | n1 | 3 << 58,
        s1[:, None] << 12 | n0 | 4 << 58,
        np.stack([a << 26 | b << 13 | c | 5 << 58 for a in halves[0] for b in halves[1] for c in halves[2]], 1),
    ]
    k = np.sort(np.concatenate(k, 1), 1)
    new = np.ones(k.shape, bool)
    new[:, 1:] = k[:, 1:] != k[:, :-1]
    row = np.nonzero(new)[0]
    return row, k[new]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash over XXH64 (seed 42) of word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*[words[i:] for i in range(size)], strict=False)]
    h64 = xxhash.xxh64_intdigest
    h = np.array([h64(x, 42) for x in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 50_000):
        ones += np.unpackbits(h[i : i + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """docs -> (doc_id, any more columns, fp long): the fingerprint's bits as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches):
            fp = np.array([fingerprint(b.raw(i)) for i in range(len(b))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(K.signed(fp))], [*own, "fp"])

    own = ["doc_id", *more]
    d = lean(docs, *own, "text")
    kinds = dict(d.dtypes)
    return d.mapInArrow(run, "".join(f"{c} {kinds[c]}, " for c in own) + "fp long")


def links(fps: DataFrame, near: int = NEAR) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) that connect what pairs within `near` bits connect."""
    ship(fps.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(0, len(fp), 20_000):
                row, key = keys(fp[i : i + 20_000].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i : i + 20_000][row])], ["key", "fp"])

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        fp, side = table.column("fp").to_numpy(), table.column("side").to_numpy()
        x = fp.view(np.uint64)
        us, vs, held = [], [], 0
        label = np.arange(len(x))
        for i, j in pairs_by_offset(starts, side):
            ok = np.bitwise_count(x[i] ^ x[j]) <= near
            us.append(i[ok])
            vs.append(j[ok])
            held += len(us[-1])
            if held > 2_000_000:
                label = forest(np.concatenate([*us, np.arange(len(x))]), np.concatenate([*vs, label]), len(x))
                us, vs, held = [], [], 0
        if us:
            label = forest(np.concatenate([*us, np.arange(len(x))]), np.concatenate([*vs, label]), len(x))
        moved = np.flatnonzero(label != np.arange(len(x)))
        edges = np.unique(np.stack([fp[moved], fp[label[moved]]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["u", "v"])

    # a row becomes some 50: dealt out first, however few files it was read from
    fps = fps.select("fp").repartition(partitions(fps.sparkSession), "fp")
    return compare(fps.mapInArrow(spread, "key long, fp long"), ["key"], "fp", kernel, "u long, v long")


def near_duplicates(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """docs (doc_id, text and any others) -> (doc_id, fp long, component_id long), a row per row.

    Lower-cases A-Z, words [^\\x20\\x09-\\x0D]+, 3-word shingles with repeats (fewer words: the whole
    sequence); documents without words (null and empty texts too) have fingerprint 0 and link like any
    other. component_id: the smallest doc_id reachable by links of `near` bits at most. Rows with a null
    doc_id keep it, link like others, and are nobody's component_id unless no other id is reachable.
    Copies collapse to one node before anything is compared, and every side of a join that is an aggregate
    is a written table, so that a hot fingerprint or group can be split. Empty tables give empty results."""
    rows = written(fingerprints(docs))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    comp = components(links(nodes, near))
    root = written(nodes.join(comp, nodes.fp == comp.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"))
    best = written(root.groupBy("root").agg(F.min("low").alias("component_id")))
    known = written(root.select("fp", "root").join(best, "root").select("fp", "component_id"))
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def heads(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """docs (doc_id, text and any others) -> (row long), one for each group of near_duplicates: the
    row_key of its row with the smallest doc_id, and of those the smallest row_key. A row without a
    doc_id stands for its group only where no row of the group has one. Groups are told apart by their
    root fingerprint, so ids that repeat in several groups, or are missing, don't join them."""
    rows = fingerprints(docs.select("doc_id", "text", row_key("doc_id", "text").alias("row")), "row")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = written(rows.groupBy("fp").agg(F.min(first).alias("low")))
    comp = components(links(nodes, near))
    root = nodes.join(comp, nodes.fp == comp.node, "left").select(F.coalesce("root", "fp").alias("root"), "low")
    return root.groupBy("root").agg(F.min("low").alias("low")).select("low.row")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
