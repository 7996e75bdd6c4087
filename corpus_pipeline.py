"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns
of documents; the last returns pieces of sequences. Every stage's result is written as Parquet and read
again as the next one's docs.

toxicity   drops documents with a score of 0.5 or more
simhash    keeps of each near-duplicate group the row with the smallest doc_id (equal rows: one)
substring  takes out words of 35-word passages that stand elsewhere too; documents left without a word go
pii        replaces personal data with [KIND]
packing    packs the rest into sequences of at most 2048 tokens

All stages but the last take and return the columns of documents, look at no others, read texts whole
whatever their length, treat equal rows alike, and give an empty table for an empty one. A null text is
kept as it is by all of them (packing: one piece of one id).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import kernels, packing, pii, simhash, substring, toxicity
from glossa.llm.runtime import row_key, ship, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from all labelled rows of sf_dir up to its documented sample, doesn't
    reject (a score under 0.5). Ids play no part: rows without one, or sharing one, stay or go by their text.
    Null and empty texts score as texts without matches and stay. Without labels the lexicon is a few words."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn_from = spark.read.parquet(f"{sf_dir}/documents.parquet")
    g = toxicity.learn(learn_from, labels)
    docs = docs.select(*COLUMNS)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.blocks(batches):
            yield b.batch.filter(pa.array([g.score(b.raw(i).decode()) < 0.5 for i in range(len(b))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, and of those the one with the smallest
    hash of (doc_id, text); of equal ones one. A document without a doc_id stays where no document of its
    group has one."""
    docs = docs.select(*COLUMNS)
    row = row_key("doc_id", "text").alias("row")
    # equal rows are put together before the shuffle, so that many copies of one don't make a hot key
    own = docs.groupBy(row).agg(F.min(F.struct("text", "lang", "source", "n_chars", "doc_id")).alias("d"))
    return own.join(simhash.heads(docs), "row", "left_semi").select(*(f"d.{c}" for c in COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; texts that lose nothing stay as they are, and
    documents that lose all their words go. Repeated rows are places of their own, so both lose what they share;
    null and empty texts and texts of fewer than 35 words stay. Null and repeated ids are ids like any other."""
    docs = docs.select(*COLUMNS).withColumn("rk", F.xxhash64("doc_id", "text"))
    cut = substring.dedup_substrings(docs).where("n_removed > 0").groupBy("rk").agg(F.min("kept").alias("kept"))
    text = F.coalesce("kept", "text")
    out = docs.join(written(cut), "rk", "left").where("kept is null or kept <> ''")
    return out.select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.length(text), F.col("n_chars")).cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars is counted anew (null for a null text). A row a row."""
    ship(spark)
    docs = docs.select(*COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.blocks(batches):
            null = b.column("text").is_null().to_pylist()
            texts = [None if null[i] else pii.redacted(b.raw(i).decode()) for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), b.column("lang"), b.column("source")], COLUMNS[:4])

    out = docs.select(*COLUMNS[:4]).mapInArrow(run, docs.select(*COLUMNS[:4]).schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed documents, as packing.pack returns them: every id of every document in one place."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("simhash", near_duplicates),
    ("substring", repeated_passages),
    ("pii", personal_data),
    ("packing", sequences),
]

#: Fingerprints, merges of ranks and learned scores have no SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again as the next one's input. The written
    tables lie in the application's own folder, which goes with it (runtime.scratch_dir)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
