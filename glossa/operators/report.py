"""Corpus reports, sampling, savings, transition graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import phonetic, text
from glossa.operators import codec, streams
from glossa.operators.model import document_bits
from glossa.operators.relations import sentences, tokens


def sample(docs: DataFrame, n: int, max_chars: int = 0, least: int = 100, seed: int = 42) -> DataFrame:
    """n documents in the order of a seeded hash: texts cut to max_chars (0: whole), short ones skipped.
    Deterministic and distributed: a top-n, not a shuffle of the corpus."""
    t = F.col("text") if not max_chars else F.left("text", F.lit(max_chars))
    key = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", t.alias("text")).where(F.length("text") >= least).withColumn("key", key).orderBy("key").limit(n)


def morph_savings(docs: DataFrame) -> DataFrame:
    """(doc_id, original_chars, root_chars, chars_saved, pct_saved)."""
    g = tokens(docs).groupBy("doc_id").agg(F.sum(F.length("word")).alias("original_chars"), F.sum(F.length("root")).alias("root_chars"))
    return g.select("doc_id", *_saved())


def _saved() -> list[Column]:
    saved = F.col("original_chars") - F.col("root_chars")
    return [F.col("original_chars"), F.col("root_chars"), saved.alias("chars_saved"), F.round(saved / F.col("original_chars") * 100, 4).alias("pct_saved")]


def delta_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, mean_cls, mean_pos, mean_role, mean_flat, mean_2d, ratio): mean absolute differences of
    neighbouring characters' coordinates over the marked words of the whole text, the first left out.

    Neighbours are pairs of characters inside a word and its marks, so they are counted by document first
    and looked up once a distinct pair; no order over the document is needed. Roles change by 6 in all in
    a word of two characters or more, and not at all in others."""
    ws = text.words(F.coalesce("text", F.lit("")))
    # counted below the explosion: beside it, the text would be split again for each word
    split = docs.select("doc_id", ws.alias("ws")).select("doc_id", "ws", F.size("ws").alias("n"))
    w = split.select("doc_id", "n", F.posexplode("ws").alias("w", "word"))
    body = F.concat(F.when(F.col("w") > 0, "_").otherwise(""), F.lit("^"), F.lower("word"), F.lit("$"), F.when(F.col("w") < F.col("n") - 1, "_").otherwise(""))
    roles = w.groupBy("doc_id").agg(F.sum(F.when(F.length("word") > 1, 6).otherwise(0)).alias("roles"))
    pairs = w.select("doc_id", F.explode(F.regexp_extract_all(body, F.lit("(?s)(?=(..))"), F.lit(1))).alias("pc")).groupBy("doc_id", "pc").agg(F.count("*").alias("n"))

    def flat(c: Column) -> Column:
        return F.when(c.rlike("^[a-z]$"), F.ascii(c) - 97).when(c == "^", 50).when(c == "$", 51).when(c == "_", 52).when(c == ".", 53).otherwise(54)

    a, b = F.left("pc", F.lit(1)), F.right("pc", F.lit(1))
    k = F.ascii(phonetic.class_string(b)) - F.ascii(phonetic.class_string(a))
    p = F.ascii(phonetic.place_string(b)) - F.ascii(phonetic.place_string(a))
    d = pairs.select("doc_id", "n", k.alias("k"), p.alias("p"), F.abs(flat(b) - flat(a)).alias("f"))
    n = F.sum("n")
    g = d.groupBy("doc_id").agg(
        n.alias("n"), (F.sum(F.col("n") * F.abs("k")) / n).alias("k"), (F.sum(F.col("n") * F.abs("p")) / n).alias("p"), (F.sum(F.col("n") * F.col("f")) / n).alias("f"),
        (F.sum(F.col("n") * F.sqrt(F.col("k") * F.col("k") + F.col("p") * F.col("p"))) / n).alias("d"),
    ).join(roles, "doc_id")
    r = F.col("roles") / F.col("n")
    return g.select("doc_id", F.round("k", 6).alias("mean_cls"), F.round("p", 6).alias("mean_pos"), F.round(r, 6).alias("mean_role"), F.round("f", 6).alias("mean_flat"), F.round("d", 6).alias("mean_2d"), F.round(F.col("f") / F.col("d"), 6).alias("ratio"))


def transition_graph(docs: DataFrame) -> DataFrame:
    """(cur, nxt, n, p): character transitions over all lines of the corpus: words as ^...$, $ -> _ -> ^
    between words of a line, signs as '.'. Words are counted first, so characters are only met once a
    distinct word."""
    lines = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "\n")).alias("line"))
    ws = lines.select(F.filter(F.split(F.regexp_replace("line", r"[^\w\s]+", "."), r"\s+"), lambda x: x != "").alias("ws")).where(F.size("ws") > 0)
    word = ws.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    pairs = word.select("n", F.explode(F.regexp_extract_all(F.concat(F.lit("^"), F.col("w"), F.lit("$")), F.lit("(?=(..))"), F.lit(1))).alias("pc"))
    edges = pairs.groupBy(F.left("pc", F.lit(1)).alias("cur"), F.right("pc", F.lit(1)).alias("nxt")).agg(F.sum("n").alias("n"))
    joins = ws.select((F.size("ws") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where("n > 0")
    edges = edges.union(joins.select(F.lit("$"), F.lit("_"), "n")).union(joins.select(F.lit("_"), F.lit("^"), "n")).groupBy("cur", "nxt").agg(F.sum("n").alias("n"))
    return edges.select("cur", "nxt", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("cur")), 8).alias("p"))


def symbol_ids(graph: DataFrame) -> DataFrame:
    """(symbol, id): by falling total probability of being reached; ties by symbol. The alphabet is small,
    so one window over its sums is."""
    s = graph.groupBy(F.col("nxt").alias("symbol")).agg(F.round(F.sum("p"), 6).alias("s"))
    return s.select("symbol", (F.row_number().over(Window.orderBy(F.desc("s"), "symbol")) - 1).alias("id"))


def greedy_walk(graph: DataFrame, start: str = "^", steps: int = 15) -> DataFrame:
    """(step, ch): the most probable next character again and again; a bounded number of joins with one
    row a character."""
    best = graph.withColumn("r", F.row_number().over(Window.partitionBy("cur").orderBy(F.desc("p"), "nxt"))).where("r = 1").select("cur", "nxt")
    spark = graph.sparkSession
    now = spark.createDataFrame([(0, start)], "step int, ch string")
    table = {r.cur: r.nxt for r in best.collect()}  # a row a character of the alphabet
    rows, ch = [(0, start)], start
    for i in range(1, steps + 1):
        ch = table.get(ch)
        if ch is None:
            break
        rows.append((i, ch))
    return spark.createDataFrame(rows, now.schema)


def char_bits(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (cur, nxt, ...) with bits: -log2 p; log2 of the number of contexts for an unknown one, log2
    1000 for an unknown edge."""
    known = graph.select("cur").distinct().withColumn("known", F.lit(True))
    n = graph.agg(F.count_distinct("cur").alias("contexts"))
    j = pairs.join(graph.select("cur", "nxt", "p"), ["cur", "nxt"], "left").join(known, "cur", "left").crossJoin(F.broadcast(n))  # one row
    bits = F.when(F.col("p").isNotNull(), -F.log2("p")).when(F.col("known"), F.log2(F.lit(1000.0))).otherwise(F.log2(F.col("contexts").cast("double")))
    return j.withColumn("bits", bits).drop("p", "known", "contexts")


def factoradic_bits(digits):
    """log2(n!) of n digits; 1 for none."""
    return F.when(digits <= 0, 1.0).otherwise(F.log2(F.factorial(digits.cast("int")).cast("double")))


def _summary(b: DataFrame, bits: str, bpb: str, size: str) -> list[Column]:
    """Mean, population deviation, least, most and pooled value of a ratio of bits to bytes."""
    return [F.round(f(bpb), 3).alias(f"{name}_{bpb}") for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))] + [F.round(F.sum(bits) / F.sum(size), 3).alias(f"pooled_{bpb}")]


def corpus_summary(docs: DataFrame) -> DataFrame:
    """One row: documents, mean, population deviation, least, most and pooled bits per byte."""
    b = document_bits(docs, trained=False, by_huffman=False, with_bytes=True).where("bpb is not null")
    return b.agg(F.count("*").alias("n_docs"), *_summary(b, "bits", "bpb", "bytes"))


def bits_by(docs: DataFrame, key: str) -> DataFrame:
    """(key, n_docs, pooled_bpb) and a total with a null key: a rollup over per-document rows."""
    b = document_bits(docs, trained=False, by_huffman=False, with_bytes=True).join(docs.select("doc_id", key), "doc_id").where("bpb is not null")
    return b.rollup(key).agg(F.count("*").alias("n_docs"), F.round(F.sum("bits") / F.sum("bytes"), 3).alias("pooled_bpb"))


def evaluation(docs: DataFrame) -> DataFrame:
    """A row a document: sizes of its archive and streams, bits per byte of the class stream and of the whole
    archive, tags' Huffman bits, seconds, and the error of one that failed (its figures are null then)."""

    def sizes(m: streams.Marked, share: streams.Share, t) -> tuple:
        if not len(m):
            return (None,) * 6
        n = np.bincount(m.tags, minlength=streams.TAGS).tolist()
        book = streams.book(m.tags)
        flat = len(m.tags) * ((len(book) - 1).bit_length() or 1)
        return int(share.lengths[share.word[t]].sum()), int(m.sizes.sum()), int(m.first.sum()), len(m.tags), sum(n[k] * len(v) for k, v in book.items()), flat

    c = codec.compressed(docs, "original_chars long, root_chars long, n_sentences long, n_tags long, huffman_bits long, flat_bits long", sizes)
    return c.select("doc_id", *c.columns[2:13], *_saved(), "n_sentences", "n_tags", "huffman_bits", "flat_bits")


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """One row of evaluation()'s: documents, errors, bytes, both ratios (mean, population deviation, least, most,
    pooled), seconds."""
    good = rows.where("error is null and bpb is not null").withColumn("archive_bits", F.col("archive_bytes") * 8)
    failed = rows.agg(F.count("*").alias("n_docs"), F.count("error").alias("n_errors"), F.sum("seconds").alias("seconds"))
    return failed.crossJoin(F.broadcast(good.agg(F.sum("original_bytes").alias("bytes"), *_summary(good, "stream_bits", "bpb", "original_bytes"), *_summary(good, "archive_bits", "payload_bpb", "original_bytes"))))  # one row each


def sentence_counts(docs: DataFrame) -> DataFrame:
    return sentences(docs).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))
