"""Sources, sinks, streams and the command line."""

import json

from pyspark.sql import functions as F

from glossa import cli
from glossa.operators import codec, model, relations, structure
from glossa.sources import readers
from glossa.streaming import documents as stream


def test_payload_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 10").select("doc_id", "text")
    pay = codec.payload(docs)
    want = {r.doc_id: r.words for r in codec.rebuilt(pay).collect()}
    for form in ("parquet", "json"):
        readers.write_payload(pay, str(tmp_path / form), form)
        assert {r.doc_id: r.words for r in codec.rebuilt(readers.read_payload(spark, str(tmp_path / form), form)).collect()} == want


def test_model_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Dogs ran home. Cats slept.")], "doc_id long, text string")
    t = relations.tokens(docs)
    p = relations.pairs(t)
    readers.write_model(model.char_context(p), model.morph_context(p), model.struct_context(t), model.mixing_weights(docs), str(tmp_path / "m"))
    back = readers.read_model(spark, str(tmp_path / "m"))
    assert sorted(back["morph"].collect()) == sorted(model.morph_context(p).collect()) and back["weights"].count() == 1


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿Hello\nthere".encode())
    r = readers.read_documents(spark, str(tmp_path / "a.txt")).collect()
    assert [x.text for x in r] == ["Hello\nthere"] and r[0].doc_id >= 0


def test_archive(spark):
    docs = spark.createDataFrame([(1, "Dogs ran home.")], "doc_id long, text string")
    f = structure.pos_frequencies(relations.tokens(docs)).withColumn("p", F.encode(F.lit("xyz"), "UTF-8"))
    counts, body = codec.read_archive(bytes(readers.frequency_archive(f, "p").first().archive))
    assert body == b"xyz" and sum(counts.values()) == 3


def test_streams(spark, sf, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 12").repartition(3).write.parquet(str(src))
    docs = stream.read_stream(spark, str(src), 1)
    q = stream.score_stream(docs, str(tmp_path / "out"), str(tmp_path / "c1"))
    q.awaitTermination()
    table = spark.read.parquet(str(src)).select("doc_id", "text")
    assert sorted(spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()) == sorted(model.context_bits(table).collect())
    q = stream.merge_counts(stream.read_stream(spark, str(src), 1), str(tmp_path / "counts"), str(tmp_path / "c2"))
    q.awaitTermination()
    want = relations.pairs(relations.tokens(table)).groupBy("code", "cls").agg(F.count("*").alias("n"))
    assert sorted(stream.read_counts(spark, str(tmp_path / "counts"), ["code", "cls"]).collect()) == sorted(want.collect())


def test_windows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert stream.windowed_events(e).agg(F.sum("n")).first()[0] == e.count()


def test_cli(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "Dogs ran home. " * 20), (2, "She was running quickly. " * 9)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert cli.main(["compress", str(tmp_path / "d"), "--out", str(tmp_path / "p")]) == 0
    assert cli.main(["decompress", str(tmp_path / "p"), "--out", str(tmp_path / "t")]) == 0
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert cli.main(["analyse", str(tmp_path / "d"), "--out", str(tmp_path / "a")]) == 0
    assert spark.read.parquet(str(tmp_path / "a")).where("bpb > 0 and ok").count() == 2
    assert cli.main(["evaluate", str(tmp_path / "d"), "--samples", "2"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["n_docs"] == 2
