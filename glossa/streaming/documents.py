"""Micro-batches of documents: the same stateless plans, and merging counts over batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossa.operators import model, relations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Bits per byte of each arriving document, appended to out. Documents are independent, so a batch is
    scored like a table; a batch that is run again overwrites its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        model.context_bits(df.select("doc_id", "text")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_counts(docs: DataFrame, out: str, checkpoint: str, counts: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Corpus-wide morph-context counts (code, cls, n), kept a batch at a time: each batch writes its own
    sums (some hundred rows), and readers add them up (read_counts), so nothing is rewritten."""
    make = counts or (lambda df: relations.pairs(relations.tokens(df)).groupBy("code", "cls").agg(F.count("*").alias("n")))

    def batch(df: DataFrame, number: int) -> None:
        make(df.select("doc_id", "text")).coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(out).groupBy(*keys).agg(F.sum("n").alias("n"))


def windowed_events(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, event_type, n, value): tumbling counts of an event stream with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
