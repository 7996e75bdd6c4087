"""Substring dedup by relative Lempel-Ziv parsing against a distributed reference index.

The reference is the whole corpus. Its index leads from phrases to places: each 35-word window elects its
smallest 6-word gram, the windows that elect the same gram form one phrase, and as that choice looks at
nothing but the window's words, a passage that occurs twice is cut alike in both places. Hash partitions of
the index are its blocks; each phrase of a document is looked up in the one block that can hold it, which
gives the first and the last place where it stands as a whole. Where a phrase is not found as a whole but
shares its gram with others - a factor's boundary - its windows are looked up one by one.

Each document is then parsed greedily from its start: a factor goes on while what follows was found on the
same diagonal of the same source document, along the first or the last places, whichever reaches further.
Factors are 35 words or longer by construction, overlap where one source ends inside another's passage, and
together cover exactly the windows whose word sequence starts anywhere else.

Equality is by 64-bit hashes of word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.runtime import forget, lean, row_key, ship, written

WINDOW, GRAM = 35, 6


def _phrases(block: K.Block, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """document, first window (word index in its document), number of windows, gram's hash, phrase's hash."""
    s, e, first = K.word_bounds(block.data, block.offs)
    h = K.span_hashes(block.data, s, e)
    n = len(h)
    doc = np.repeat(np.arange(len(block)), np.diff(first))
    i = np.flatnonzero(doc[: max(0, n - window + 1)] == doc[window - 1 :])
    if not len(i):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    grams, windows = K.sequences(h, gram), K.sequences(h, window)
    elected = K.leftmost_min(grams, window - gram + 1)
    new = np.ones(len(i), bool)
    new[1:] = (elected[i[1:]] != elected[i[:-1]]) | (i[1:] != i[:-1] + 1) | (doc[i[1:]] != doc[i[:-1]])
    a = i[new]
    count = np.diff(np.append(np.flatnonzero(new), len(i)))
    # at most window - gram + 1 windows: the first and the last overlap and fix all words
    whole = K.mix(windows[a] * np.uint64(0x9E3779B97F4A7C15) + K.mix(windows[a + count - 1] + count.astype(np.uint64)))
    return doc[a], a - first[doc[a]], count, K.signed(grams[elected[a]]), K.signed(whole)


def phrases(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(rk, a, n, anchor, phrase): one row per phrase; rk is the key of the document's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches):
            d, a, n, anchor, whole = _phrases(b, window, gram)
            rk = b.column("rk").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rk[d]), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(whole)], ["rk", "a", "n", "anchor", "phrase"])

    return docs.select("rk", "text").mapInArrow(run, "rk long, a int, n int, anchor long, phrase long")


def packed(docs: DataFrame, *keys: str) -> DataFrame:
    """The keys and the text as zstd frames: what a shuffle of whole texts moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in K.blocks(batches):
            null = b.column("text").is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array([None if null[i] else z.compress(b.raw(i)) for i in range(len(b))], pa.binary())], [*keys, "z"])

    types = dict(docs.dtypes)
    return docs.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", z binary")


def unpacked(batch: pa.RecordBatch, i: int, z: zstandard.ZstdDecompressor) -> bytes:
    v = batch.column(batch.schema.get_field_index("z"))[i].as_py()
    return b"" if v is None else z.decompress(v)


_FACTORS = "array<struct<start:int,length:int,source:long,at:int>>"


def parse(rk: int, a: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], high: tuple[np.ndarray, np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, source's key, place there) of the document rk, in words. a, n: first
    windows and numbers of windows of what was found; low and high: keys and places of its first and its
    last occurrence (the place itself, where a row is repeated)."""
    _, order = np.unique(a, return_index=True)
    a, n = a[order], n[order]
    m = len(a)
    joined = a[1:] == a[:-1] + n[:-1]
    sources, ends = [], []
    own = [(k[order] == rk) & (p[order] == a) for k, p in (low, high)]
    for (k, p), (k2, p2), mine in ((low, high, own[0]), (high, low, own[1])):
        k, p = np.where(mine, k2[order], k[order]), np.where(mine, p2[order], p[order])
        breaks = ~(joined & (k[1:] == k[:-1]) & (p[1:] - a[1:] == p[:-1] - a[:-1]))
        last = np.append(np.flatnonzero(breaks), m - 1)
        sources.append((k, p))
        ends.append(last[np.searchsorted(last, np.arange(m))])
    which = (ends[1] > ends[0]).astype(int)
    out, i = [], 0
    while i < m:
        c = int(which[i])
        e = int(ends[c][i])
        out.append((int(a[i]), int(a[e] + n[e] + window - 1 - a[i]), int(sources[c][0][i]), int(sources[c][1][i])))
        i = e + 1
    return out


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs (rk, text) -> (rk, factors array<struct<start,length,source,at>>): the greedy parse of each row's
    text, in words; at each factor's `at` in the row keyed `source` stand the same words. Only rows with
    factors appear; equal rows have one key and appear once."""
    ship(docs.sparkSession)
    all_ = written(phrases(docs, window, gram))
    # written, so that the joins below have plain shuffles on both sides, which can be split when skewed
    shared = written(all_.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    hot = written(all_.join(shared, "anchor", "left_semi"))
    forget(all_)
    forget(shared)
    place = F.struct("rk", "a")
    index = written(hot.groupBy("anchor", "phrase").agg(F.count("*").alias("c"), F.min(place).alias("low"), F.max(place).alias("high"), F.first("n").alias("n")))
    whole = hot.join(index.where("c > 1").select("anchor", "phrase", "low", "high"), ["anchor", "phrase"]).select("rk", "a", "n", "low", "high")

    mixed = written(index.groupBy("anchor").agg(F.count("*").alias("m"), F.min("c").alias("least")).where("m > 1 and least = 1").select("anchor"))
    open_ = index.join(mixed, "anchor").select("low.rk", "low.a", "n", F.expr("c = 1 as single"))
    open_ = open_.groupBy("rk").agg(F.collect_list(F.struct("a", "n", "single")).alias("open"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rks, spans = part.column(0).to_pylist(), part.column(1).to_pylist()
                out: list[list[np.ndarray]] = [[], [], [], []]
                for i, rk in enumerate(rks):
                    data = np.frombuffer(unpacked(part, i, z), np.uint8)
                    s, e, _ = K.word_bounds(data, np.array([0, len(data)]))
                    w = K.sequences(K.span_hashes(data, s, e), window)
                    a = np.array([x["a"] for x in spans[i]])
                    n = np.array([x["n"] for x in spans[i]])
                    one = np.repeat(np.array([x["single"] for x in spans[i]]), n)
                    at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    for o, v in zip(out, (K.signed(w[at]), np.full(len(at), rk), at.astype(np.int32), one), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["w", "rk", "a", "single"])

    texts = packed(docs, "rk")
    w = written(open_.join(texts, "rk").select("rk", "open", "z").mapInArrow(windows, "w long, rk long, a int, single boolean"))
    again = w.groupBy("w").agg(F.count("*").alias("c"), F.max("single").alias("any"), F.min(place).alias("low"), F.max(place).alias("high"))
    again = written(again.where("c > 1 and any").select("w", "low", "high"))
    edge = w.where("single").join(again, "w").select("rk", "a", F.lit(1).alias("n"), "low", "high")
    found = whole.union(edge).select("rk", F.struct("a", "n", F.col("low.rk").alias("k0"), F.col("low.a").alias("p0"), F.col("high.rk").alias("k1"), F.col("high.a").alias("p1")).alias("x"))

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lists = batch.column(0).to_numpy(), batch.column(1)
            first = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            flat = lists.flatten()
            a, n, k0, p0, k1, p1 = (flat.field(c).to_numpy() for c in ("a", "n", "k0", "p0", "k1", "p1"))
            each = [parse(int(own[i]), a[x:y], n[x:y], (k0[x:y], p0[x:y]), (k1[x:y], p1[x:y]), window) for i, (x, y) in enumerate(zip(first[:-1], first[1:], strict=True))]
            rows = np.array([f for fs in each for f in fs], np.int64).reshape(-1, 4)
            names = ["start", "length", "source", "at"]
            body = pa.StructArray.from_arrays([pa.array(rows[:, i].astype(t)) for i, t in enumerate((np.int32, np.int32, np.int64, np.int32))], names)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]).astype(np.int32)), body)], ["rk", "factors"])

    out = written(found.groupBy("rk").agg(F.collect_list("x").alias("x")).mapInArrow(greedy, f"rk long, factors {_FACTORS}"))
    for t in (hot, index, mixed, w, again):
        forget(t)
    return out


def covered(n_words: int, spans: list | None) -> np.ndarray:
    """Which words some factor covers."""
    step = np.zeros(n_words + 1, np.int64)
    for x in spans or ():
        step[x["start"]] += 1
        step[min(x["start"] + x["length"], n_words)] -= 1
    return np.cumsum(step)[:n_words] > 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text and any others) -> (doc_id, rk, n_words long, n_removed long, kept string).

    Words are [^\\x20\\x09-\\x0D]+; each word covered by a window of 35 words whose sequence also starts
    anywhere else is removed, in every place, and the kept words are joined by one space. Null and empty
    texts have no words and give ''. Repeated rows count as places of their own, and null ids are ids like any
    other. Texts of fewer than 35 words are kept whole, long ones are read whole. Columns beside doc_id and
    text are not read. An empty table gives an empty result."""
    ship(docs.sparkSession)
    d = lean(docs, "doc_id", "text").withColumn("rk", row_key("doc_id", "text"))
    joined = packed(d, "doc_id", "rk").join(factors(d, window), "rk", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                spans = part.column(3).to_pylist()
                n_words, gone, kept = [], [], []
                for i in range(part.num_rows):
                    words = unpacked(part, i, z).split()
                    n_words.append(len(words))
                    out = covered(len(words), spans[i]) if spans[i] else None
                    gone.append(0 if out is None else int(out.sum()))
                    if out is not None:
                        words = [words[j] for j in np.flatnonzero(~out)]
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "rk", "n_words", "n_removed", "kept"])

    kind = dict(d.dtypes)["doc_id"]
    return joined.select("doc_id", "rk", "z", "factors").mapInArrow(cut, f"doc_id {kind}, rk long, n_words long, n_removed long, kept string")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
