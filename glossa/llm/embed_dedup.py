"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and quantised with step WIDTH; PER
such numbers make a bucket in each of TABLES tables. Rows travel to their buckets with a sketch only (SKETCH
more quantised projections, a byte each), which tells who can have a partner there at all; only those are
joined with their vectors, and compared by exact cosine in double precision. Equal vectors collapse to one
class first. PER grows with the logarithm of the number of classes, so that buckets stay small, and TABLES
with it, so that a pair exactly at the threshold is missed with probability MISS at most; closer pairs are
found more often. The sketch misses a pair at the threshold with probability SKETCH_MISS in a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.buckets import compare, forest, pairs_by_offset
from glossa.llm.graph import components
from glossa.llm.runtime import ship, written

COSINE, WIDTH, MISS, SMALL = 0.9, 2.0, 0.01, 12
SKETCH, STEP, SKETCH_MISS = 32, 128, 1e-6  # projections, steps a unit
_Z = 4.7534  # of a normal variable, exceeded with probability SKETCH_MISS


def _collision(distance: float, width: float) -> float:
    """Probability that one quantised projection agrees for two points this far apart."""
    t = width / distance
    phi = 0.5 * (1 + math.erf(-t / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(classes: int, cosine: float = COSINE, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """PER and TABLES for so many distinct vectors."""
    far, near = _collision(math.sqrt(2), width), _collision(max(1e-6, math.sqrt(2 - 2 * cosine)), width)
    per = max(8, math.ceil(math.log(max(classes, 1) / 50 + 1) / -math.log(far)))
    return per, max(1, math.ceil(math.log(miss) / math.log1p(-(near**per))))


@cache
def _directions(dim: int, n: int, width: float, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, n)), rng.uniform(0, width, n)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def codes(x: np.ndarray, per: int, tables: int, width: float = WIDTH) -> np.ndarray:
    """n x tables bucket numbers (int32) of unit vectors."""
    a, b = _directions(x.shape[1], per * tables, width)
    q = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, per)
    h = np.full((len(x), tables), x.shape[1], np.uint64)
    for i in range(per):
        h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + q[:, :, i].view(np.uint64))
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def classes(vectors: DataFrame) -> DataFrame:
    """(ck, embedding, low, n): distinct usable vectors; ck is a 64-bit key of the components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    usable = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull()).where(good)
    return usable.groupBy(F.xxhash64("embedding").alias("ck"), "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))


def sketches(x: np.ndarray) -> np.ndarray:
    """n x SKETCH bytes: quantised projections, whose squared distances follow the vectors'."""
    a, _ = _directions(x.shape[1], SKETCH, 1.0, 21)
    return np.clip(np.rint(x @ a * (STEP / math.sqrt(SKETCH))), -127, 127).astype(np.int8)


def _near(cosine: float) -> float:
    """The squared distance of sketches that a pair at the threshold stays under: a chi-square quantile
    (Wilson-Hilferty), and the rounding of SKETCH numbers."""
    c = 2 / (9 * SKETCH)
    d = math.sqrt(max(0.0, 2 - 2 * cosine) * (1 - c + _Z * math.sqrt(c)) ** 3)
    return (d * STEP + math.sqrt(SKETCH)) ** 2


def coded(cls: DataFrame, per: int, tables: int, width: float = WIDTH) -> DataFrame:
    """cls (ck, embedding, n) -> (ck, n, vec, codes, sketch): vectors as bytes, and their bucket numbers."""
    wide = np.float32 if dict(cls.dtypes)["embedding"] == "array<float>" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                e = batch.column(1)
                vals, offs = np.asarray(e.flatten()), np.asarray(e.offsets) - e.offsets[0].as_py()
                for dim in np.unique(np.diff(offs)):
                    rows = np.flatnonzero(np.diff(offs) == dim)
                    x = vals[offs[rows][:, None] + np.arange(dim)].astype(wide)
                    u = unit(x)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in (0, 2)), *(pa.array([r.tobytes() for r in v], pa.binary()) for v in (x, codes(u, per, tables, width), sketches(u)))], ["ck", "n", "vec", "codes", "sketch"])

    return cls.select("ck", "embedding", "n").mapInArrow(run, "ck long, n long, vec binary, codes binary, sketch binary")


def candidates(rows: DataFrame, tables: int, cosine: float = COSINE) -> DataFrame:
    """coded rows -> (key, ck): in which buckets (table << 32 | number) a row has another one near its sketch."""
    near = _near(cosine)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 5000):
                b = whole.slice(k, 5000)
                code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, tables).astype(np.int64)
                take = pa.array(np.repeat(np.arange(len(code)), tables))
                yield pa.RecordBatch.from_arrays([pa.array((code | np.arange(tables) << 32).reshape(-1)), b.column(0).take(take), b.column(2).take(take)], ["key", "ck", "sketch"])

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        key, ck, side = (table.column(c).to_numpy() for c in ("key", "ck", "side"))
        x = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.int8).reshape(-1, SKETCH).astype(np.float32)
        norm = np.einsum("ij,ij->i", x, x)
        live = np.zeros(len(ck), bool)
        for i, j in pairs_by_offset(starts, side, SMALL):  # whole numbers: sums are exact either way
            ok = norm[i] + norm[j] - 2 * np.einsum("ij,ij->i", x[i], x[j]) <= near
            live[i[ok]] = live[j[ok]] = True
        for k in np.flatnonzero(np.diff(starts) > SMALL):
            rows = np.arange(starts[k], starts[k + 1])
            left, right = (rows, rows) if side[rows[0]] == 0 else (rows[side[rows] == 1], rows[side[rows] == 2])
            if len(left) and len(right):
                close = norm[left][:, None] + norm[right] - 2 * (x[left] @ x[right].T) <= near
                if left is right:
                    np.fill_diagonal(close, False)
                live[left] |= close.any(1)
                live[right] |= close.any(0)
        at = np.flatnonzero(live)
        return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(ck[at])], ["key", "ck"])

    keyed = rows.select("ck", "codes", "sketch").mapInArrow(spread, "key long, ck long, sketch binary")
    return compare(keyed, ["key"], "ck", kernel, "key long, ck long").distinct()


def neighbours(rows: DataFrame, where: DataFrame, tables: int, wide: type, cosine: float = COSINE) -> DataFrame:
    """coded rows, compared in the buckets `where` (key, ck) -> (u, v, links): for rows with a partner, a partner
    or itself by which the row is connected, and how many vectors it was found to link with; each pair counts
    once, in the first table in which it shares a bucket."""

    def kernel(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        key, ck, n, side = (table.column(c).to_numpy() for c in ("key", "ck", "n", "side"))
        tab = key >> 32
        body = table.column("vec").combine_chunks()
        code = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int32).reshape(len(ck), tables)
        links = np.zeros(len(ck), np.int64)
        us, vs = [np.arange(len(ck))], [np.arange(len(ck))]
        size = np.diff(starts)

        def vectors(at: np.ndarray) -> np.ndarray | None:
            raw = body.take(pa.array(at)).to_pylist()
            if len({len(r) for r in raw}) > 1:
                return None
            return unit(np.frombuffer(b"".join(raw), wide).reshape(len(at), -1))

        def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Whether rows of x and y are near: one way of summing, whatever the bucket's size."""
            return np.einsum("ij,ij->i", x, y) >= cosine

        def found(i: np.ndarray, j: np.ndarray) -> None:
            us.append(i)
            vs.append(j)
            for k in range(0, len(i), 50_000):
                a, b = i[k : k + 50_000], j[k : k + 50_000]
                before = np.arange(tables)[None, :] < tab[a][:, None]
                new = ~((code[a] == code[b]) & before).any(1)
                np.add.at(links, a[new], n[b[new]])
                np.add.at(links, b[new], n[a[new]])
            if sum(map(len, us)) > 3_000_000:
                label = forest(np.concatenate(us), np.concatenate(vs), len(ck))
                us[:], vs[:] = [np.arange(len(ck))], [label]

        small = np.repeat(size <= SMALL, size)
        at = np.flatnonzero(small)
        if len(at):
            x, place = vectors(at), np.cumsum(small) - 1
            for i, j in pairs_by_offset(starts, side, SMALL):
                if x is not None:
                    ok = alike(x[place[i]], x[place[j]])
                else:
                    ok = np.array([(p := vectors(np.array(ij))) is not None and bool(alike(p[:1], p[1:])[0]) for ij in zip(i, j, strict=True)], bool)
                found(i[ok], j[ok])
        for k in np.flatnonzero(size > SMALL):
            every = np.arange(starts[k], starts[k + 1])
            length = np.array([len(r) for r in body.take(pa.array(every)).to_pylist()])
            for m in np.unique(length):  # vectors of different lengths meet by chance only
                rows = every[length == m]
                left, right = (rows, rows) if side[rows[0]] == 0 else (rows[side[rows] == 1], rows[side[rows] == 2])
                if not len(left) or not len(right):
                    continue
                x, at = vectors(rows), {int(r): i for i, r in enumerate(rows)}
                a, b = (x[[at[int(r)] for r in side_rows]] for side_rows in (left, right))
                s = a @ b.T
                i, j = np.nonzero(np.triu(s >= cosine - 1e-9, 1) if left is right else s >= cosine - 1e-9)
                edge = np.flatnonzero(np.abs(s[i, j] - cosine) < 1e-9)
                keep = np.ones(len(i), bool)
                keep[edge] = alike(a[i[edge]], b[j[edge]])
                found(left[i[keep]], right[j[keep]])
        label = forest(np.concatenate(us), np.concatenate(vs), len(ck))
        out = np.flatnonzero((links > 0) | (label != np.arange(len(ck))))
        return pa.RecordBatch.from_arrays([pa.array(ck[out]), pa.array(ck[label[out]]), pa.array(links[out])], ["u", "v", "links"])

    return compare(where.join(rows.drop("sketch"), "ck").select("key", "ck", "n", "vec", "codes"), ["key"], "ck", kernel, "u long, v long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, width: float = WIDTH) -> DataFrame:
    """vectors (vec_id long, embedding array<float|double> and any others) -> (vec_id, n_links long,
    component_id long, kept boolean), a row per row, whatever the labels.

    Links have cosine >= 0.9 in double precision. Null, empty and zero vectors, and those with null or
    non-finite components, link with nothing. Vectors of different lengths don't link. Equal vectors
    always link. component_id is the smallest vec_id reachable; a null vec_id keeps its row, and of a repeated
    vec_id each row counts as a vector of its own. Long vectors are compared whole; other columns are not
    read. Empty tables give empty results."""
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col("vec_id"), F.col("embedding"))
    cls = written(classes(v))
    per, tables = plan(cls.count(), cosine, width)
    rows = written(coded(cls, per, tables, width))
    where = written(candidates(rows, tables, cosine))
    wide = np.float32 if dict(cls.dtypes)["embedding"] == "array<float>" else np.float64
    pairs = written(neighbours(rows, where, tables, wide, cosine))
    comp = components(pairs.select("u", "v"))
    # aggregated sides are written, so that the joins with them can be split where a key is hot
    links = written(pairs.groupBy(F.col("u").alias("ck")).agg(F.sum("links").alias("links")))
    nodes = cls.select("ck", "low", "n").join(comp, F.col("ck") == F.col("node"), "left").join(links, "ck", "left")
    nodes = written(nodes.select("ck", F.coalesce("root", "ck").alias("root"), "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    best = written(nodes.groupBy("root").agg(F.min("low").alias("component_id")))
    known = written(nodes.join(best, "root").select("ck", "n_links", "component_id"))
    good = F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)
    keyed = v.select("vec_id", F.when(good, F.xxhash64("embedding")).alias("ck"))
    out = keyed.join(known, "ck", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
