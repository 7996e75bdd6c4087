"""Comparison of the rows of a bucket with each other, for buckets of any size.

Rows carry a bucket key. Keys are counted first (pre-aggregated); buckets of one row go. A bucket of
more than `chunk` rows is dealt into chunks, and each pair of chunks becomes a job of its own, so no
task ever holds more than two chunks of one bucket. A kernel sees whole jobs and returns what it found
in a form that doesn't grow with the number of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.runtime import partitions, written


def compare(rows: DataFrame, key: list[str], item: str, kernel: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str, chunk: int = 2048) -> DataFrame:
    """rows: the key columns, the column item (distinct within a bucket) and others. kernel(table, starts):
    rows of whole jobs, sorted by job, and where each job begins (and the end); the column `side` is 0
    in a chunk's own job, else 1 or 2, and only rows of different sides need comparing then."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("in_bucket")).where("in_bucket > 1").withColumn("chunks", F.ceil(F.col("in_bucket") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64(F.col(item), F.lit(7)), F.col("chunks")).cast("int")
    # written, so that a hot bucket's rows can be split in the join
    dealt = rows.join(written(counts.drop("in_bucket")), key).withColumn("mine", F.when(F.col("chunks") > 1, mine).otherwise(0))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("chunks") > 1, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.lit(0)))))
    dealt = dealt.withColumn("job", F.least("mine", "other") * F.lit(1 << 20).cast("long") + F.greatest("mine", "other"))
    dealt = dealt.withColumn("side", F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("int"))
    jobs = [*key, "job"]
    dealt = dealt.drop("chunks", "mine", "other").repartition(partitions(rows.sparkSession), *jobs).sortWithinPartitions(*jobs, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 60_000:
                table = pa.Table.from_batches(held)
                starts = _starts(table, jobs)
                if len(starts) > 2:
                    yield kernel(table.slice(0, starts[-2]), starts[:-1])
                    table = table.slice(starts[-2])
                held, n = table.to_batches(), table.num_rows
        if n:
            table = pa.Table.from_batches(held)
            yield kernel(table, _starts(table, jobs))

    return dealt.mapInArrow(run, schema)


def _starts(table: pa.Table, jobs: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in jobs:
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Labels 0..n-1 of the components of the edges u-v: the smallest index in each."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        live = a != b
        if not live.any():
            break
        u, v, a, b = u[live], v[live], a[live], b[live]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def pairs_by_offset(starts: np.ndarray, side: np.ndarray, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of rows in one job that need comparing, an offset j - i at a time; with
    most, only of jobs of so many rows."""
    size = np.diff(starts)
    left = np.repeat(starts[1:], size) - np.arange(starts[-1])  # rows from i to its job's end
    i = np.flatnonzero((left > 1) & (True if most is None else np.repeat(size <= most, size)))
    d = 1
    while len(i):
        j = i + d
        ok = (side[i] == 0) | (side[i] != side[j])
        yield i[ok], j[ok]
        d += 1
        i = i[left[i] > d]
