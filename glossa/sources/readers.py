"""Sources and sinks: text, Parquet and JSON tables in, payloads and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions.text import without_bom
from glossa.operators import codec

PAYLOAD = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("roots", T.ArrayType(T.StringType())),
        T.StructField("codes", T.ArrayType(T.IntegerType())),
        T.StructField("exceptions", T.MapType(T.IntegerType(), T.StringType())),
    ]
)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, path): a row a file, whole, without a byte order mark. doc_id is a 63-bit hash of the
    path, so that numbering needs no ordering of files."""
    t = spark.read.text(path, wholetext=True).select(without_bom(F.col("value")).alias("text"), F.col("_metadata.file_path").alias("path"))
    return t.select((F.xxhash64("path").bitwiseAND(F.lit((1 << 63) - 1))).alias("doc_id"), "text", "path")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, ...) from a file or folder: Parquet, JSON lines or text, by its ending."""
    name = path.rstrip("/")
    if name.endswith((".json", ".jsonl")):
        return spark.read.schema("doc_id long, text string").json(path)
    if name.endswith((".txt", ".md")):
        return read_text(spark, path)
    return spark.read.parquet(path)


def write_payload(payload: DataFrame, path: str, form: str = "parquet") -> None:
    """Payloads (roots and codes) or archives: Parquet in zstd, or JSON lines (archives in base 64)."""
    w = payload.write.mode("overwrite")
    if form == "json":
        w.json(path)
    else:
        w.option("compression", "zstd").parquet(path)


def read_payload(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """What write_payload wrote: (doc_id, archive) where there are archives, else the roots and codes. In JSON
    a map's keys are text and archives are base 64."""
    if form == "json":
        raw = spark.read.schema("doc_id long, archive string, roots array<string>, codes array<int>, exceptions map<string,string>").json(path)
        keys = F.map_from_entries(F.transform(F.map_entries("exceptions"), lambda e: F.struct(e["key"].cast("int"), e["value"])))
        raw = raw.withColumns({"exceptions": keys, "archive": F.unbase64("archive")})
        return raw.select("doc_id", "archive") if raw.where("archive is not null").limit(1).count() else raw.drop("archive")
    found = spark.read.parquet(path)
    return found.select("doc_id", "archive") if "archive" in found.columns else spark.read.schema(PAYLOAD).parquet(path)


def sizes(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The figures that were written beside the archives."""
    kinds = "doc_id long, original_bytes long, n_words long, n_symbols long, stream_bytes long, archive_bytes long, stream_bits double, bpb double, payload_bpb double, ratio double, seconds double, error string"
    r = spark.read.schema(kinds)
    return r.json(path) if form == "json" else r.parquet(path)


def read_words(payload: DataFrame) -> DataFrame:
    """(doc_id, words, text) of either form."""
    return codec.decompressed(payload) if "archive" in payload.columns else codec.rebuilt(payload)


def write_model(char: DataFrame, morph: DataFrame, struct: DataFrame, weights: DataFrame, path: str) -> None:
    """The three context tables and the weights, a Parquet table each."""
    for name, df in (("char", char), ("morph", morph), ("struct", struct), ("weights", weights)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("char", "morph", "struct", "weights")}


def frequency_archive(counts: DataFrame, payload: str) -> DataFrame:
    """(doc_id, archive binary) from (doc_id, tag, n) and a column of bytes: the length of a JSON table in 4
    bytes, the table, the bytes; all in column expressions."""
    table = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "n")))))
    rows = counts.groupBy("doc_id").agg(table.alias("t"), F.first(payload).alias("p"))
    head = F.unhex(F.lpad(F.hex(F.octet_length("t").cast("long")), 8, "0"))
    return rows.select("doc_id", F.concat(head, F.encode("t", "UTF-8"), F.col("p")).alias("archive"))
