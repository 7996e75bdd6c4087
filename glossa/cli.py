"""python -m glossa.cli compress|decompress|analyse|evaluate|round-trip: the engine from a shell or spark-submit."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import codec, discourse, model, relations, report, structure
from glossa.sources import readers


def analysis(docs: DataFrame) -> DataFrame:
    """One row a document: savings, deltas, bits per byte under its trained model, tag codes, symbols."""
    parts = [report.morph_savings(docs), report.delta_stats(docs), model.document_bits(docs), structure.huffman_summary(docs).drop("n_symbols"), discourse.symbol_report(docs).select("doc_id", "ok", "n_words_before", "n_words_after")]
    out = docs.select("doc_id")
    for p in parts:
        out = out.join(p, "doc_id", "left")
    return out


def round_trip(docs: DataFrame, symbols: bool = True) -> DataFrame:
    """(doc_id, n_words, n_lost, overlap, first_mismatch): words of each document against those of its archive
    decoded again; with symbols, repeated names go through their symbols and back before that."""
    if symbols:
        docs = discourse.encoded_symbols(docs).select("doc_id", F.col("decoded").alias("text"))
    words = relations.tokens(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_id", "tok_id", "word"))).alias("r")).select("doc_id", F.col("r.word").alias("a"))
    both = words.join(codec.decompressed(codec.compressed(docs)).select("doc_id", F.col("words").alias("b")), "doc_id")
    differs = F.zip_with("a", "b", lambda x, y: ~x.eqNullSafe(y))
    lost = F.size(F.filter(differs, lambda x: x))
    return both.select("doc_id", F.size("a").alias("n_words"), lost.alias("n_lost"), F.round(1 - lost / F.size("a"), 6).alias("overlap"), (F.array_position(differs, True) - 1).alias("first_mismatch"))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="glossa")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("compress", "decompress", "analyse", "evaluate", "round-trip"):
        s = sub.add_parser(name)
        s.add_argument("source")
        s.add_argument("--out")
        s.add_argument("--form", choices=["parquet", "json"], default="parquet")
        s.add_argument("--readable", action="store_true", help="compress: roots and codes instead of archives")
        s.add_argument("--samples", type=int, default=50)
        s.add_argument("--chars", type=int, default=0)
        s.add_argument("--seed", type=int, default=42)
        s.add_argument("--no-discourse", action="store_true")
        s.add_argument("--verbose", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("glossa").getOrCreate()
    if a.what == "decompress":
        words = readers.read_words(readers.read_payload(spark, a.source, a.form)).select("doc_id", "text")
        words.write.mode("overwrite").parquet(a.out) if a.out else words.show(truncate=80)
        return 0
    docs = readers.read_documents(spark, a.source).select("doc_id", "text")
    if a.what in ("compress", "round-trip") and a.chars:
        docs = docs.withColumn("text", F.left("text", F.lit(a.chars)))
    if a.what == "compress":
        if not a.out:
            p.error("compress needs --out")
        readers.write_payload(codec.payload(docs) if a.readable else codec.compressed(docs), a.out, a.form)
        if not a.readable:
            done = report.evaluation_summary(readers.sizes(spark, a.out, a.form)).first().asDict()
            print(json.dumps(done))
    elif a.what == "analyse":
        out = analysis(docs)
        out.write.mode("overwrite").parquet(a.out) if a.out else out.show(truncate=30)
    elif a.what == "round-trip":
        out = round_trip(docs, not a.no_discourse)
        if a.out:
            out.write.mode("overwrite").parquet(a.out)
        print(json.dumps(out.agg(F.sum("n_words").alias("n_words"), F.sum("n_lost").alias("n_lost"), F.min("overlap").alias("min_overlap")).first().asDict()))
    else:
        picked = report.sample(docs, a.samples, a.chars, seed=a.seed)
        rows = report.evaluation(picked.select("doc_id", "text"))
        if a.out:
            rows.write.mode("overwrite").json(f"{a.out}/per_sample")
            rows = spark.read.schema(rows.schema).json(f"{a.out}/per_sample")
        summary = report.evaluation_summary(rows)
        if a.out:
            summary.write.mode("overwrite").json(f"{a.out}/summary")
        if a.verbose:
            rows.show(a.samples, truncate=30)
        print(json.dumps(summary.withColumn("samples", F.lit(a.samples)).first().asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
