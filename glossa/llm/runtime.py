"""Session helpers: shared scratch tables, shipping of this package, partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parents[2]


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared folder that the cluster names. It is deleted when the
    driver ends, or by sweep() before. Where no shared folder is named, a local one serves a local master
    (tests); on a cluster that is an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    kept = getattr(sc, "_glossa_scratch", None)
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="glossa-scratch-")
        sc.setCheckpointDir(named)
    if kept is None or kept[0] != named:
        own = f"{named.rstrip('/')}/glossa-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        fs, p = _found(spark, own)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        sc._glossa_scratch = kept = (named, own)
    return kept[1]


def _found(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost
    executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glossa_path = path
    return out


def sweep(spark: SparkSession) -> None:
    """Delete the tables that written() has left for this application: for the end of a job, when no plan
    will read them again."""
    kept = getattr(spark.sparkContext, "_glossa_scratch", None)
    if kept:
        fs, p = _found(spark, kept[1])
        fs.delete(p, True)
        spark.sparkContext._glossa_scratch = None


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that no later plan reads."""
    path = getattr(df, "_glossa_path", None)
    if path:
        fs, p = _found(df.sparkSession, path)
        fs.delete(p, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, and switch off an unsafe setting: Spark 4.1 takes a union
    of children with equal hash partitioning as partitioned like them, also when adaptive execution has
    coalesced only one, and aggregates above count rows twice. With a local master, workers share the
    driver's PYTHONPATH, and nothing is sent where that already has the package."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if getattr(sc, "_glossa_shipped", False) or sc.master.startswith("local") and str(_ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    to = Path(tempfile.mkdtemp(prefix="glossa-ship-")) / "glossa_pkg.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((_ROOT / "glossa").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(to))
    sc._glossa_shipped = True


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_key(*cols: str) -> Column:
    """64-bit key of a row's own content: equal rows share it, nulls are allowed."""
    return F.xxhash64(*[F.col(c) for c in cols])


def lean(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, in order, with exact-name lookup (extra columns can't clash)."""
    return docs.select(*[F.col(f"`{c}`") for c in cols])
