"""Per-document context model: counts, smoothed distributions, mixing, bits per byte."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators import streams
from glossa.operators.relations import pairs, tokens
from glossa.operators.streams import FLOOR, RATE


def char_context(p: DataFrame) -> DataFrame:
    """(doc_id, prev, cls, n): pairs of classes inside sentences."""
    return p.where(~F.col("opens")).groupBy("doc_id", "prev", "cls").agg(F.count("*").alias("n"))


def morph_context(p: DataFrame) -> DataFrame:
    """(doc_id, code, cls, n)."""
    return p.groupBy("doc_id", "code", "cls").agg(F.count("*").alias("n"))


def struct_context(t: DataFrame) -> DataFrame:
    """(doc_id, tag, code, n)."""
    return t.groupBy("doc_id", "tag", "code").agg(F.count("*").alias("n"))


def vocabularies(p: DataFrame, t: DataFrame) -> DataFrame:
    """(doc_id, char_vocab, morph_vocab, pos_vocab), sorted arrays."""
    c = p.groupBy("doc_id").agg(F.sort_array(F.collect_set("cls")).alias("char_vocab"))
    m = t.groupBy("doc_id").agg(F.sort_array(F.collect_set("code")).alias("morph_vocab"), F.sort_array(F.collect_set("tag")).alias("pos_vocab"))
    return c.join(m, "doc_id")


def smoothed(counts: DataFrame, context: str, contexts: DataFrame, symbols: DataFrame, symbol: str = "cls") -> DataFrame:
    """(doc_id, context, symbol, p): add-one over the document's symbols, for all of its contexts. The
    frame is documents x contexts x symbols: 7 x 13 at most a document."""
    frame = contexts.select("doc_id", context).distinct().join(symbols.select("doc_id", symbol).distinct(), "doc_id")
    w = Window.partitionBy("doc_id", context)
    full = frame.join(counts, ["doc_id", context, symbol], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("doc_id", context, symbol, ((F.col("n") + 1) / (F.sum("n").over(w) + F.count("*").over(w))).alias("p"))


def joint(p: DataFrame) -> DataFrame:
    """(doc_id, prev, code, tag, cls, opens, tok_code, tok_tag, n): the only pass over characters; some
    hundred rows a document, from which all other tables follow, so it is kept (on disk where memory is
    short; a lost part is computed again)."""
    keys = ["doc_id", "prev", "code", "tag", "cls", "opens", "tok_code", "tok_tag"]
    return p.groupBy(*keys).agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)


def distributions(j: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """p1(doc_id, prev, cls), p2(doc_id, code, cls), p3(doc_id, tag, cls) for all contexts that occur. A tag
    without words of its own has all codes evenly."""
    n1 = j.where(~F.col("opens")).groupBy("doc_id", "prev", "cls").agg(F.sum("n").alias("n"))
    n2 = j.groupBy("doc_id", "code", "cls").agg(F.sum("n").alias("n"))
    words = j.where("tok_code is not null").groupBy("doc_id", F.col("tok_tag").alias("tag"), F.col("tok_code").alias("code")).agg(F.sum("n").alias("n"))
    symbols = j.select("doc_id", "cls").distinct()
    p1 = smoothed(n1, "prev", j, symbols).withColumnRenamed("p", "p1")
    p2 = smoothed(n2, "code", j, symbols).withColumnRenamed("p", "p2")
    by_tag = smoothed(words, "tag", j, words, "code")
    mix = by_tag.join(p2, ["doc_id", "code"]).groupBy("doc_id", "tag", "cls").agg(F.sum(F.col("p") * F.col("p2")).alias("q"))
    p3 = mix.select("doc_id", "tag", "cls", (F.col("q") / F.sum("q").over(Window.partitionBy("doc_id", "tag"))).alias("p3"))
    return p1, p2, p3


def document_bits(docs: DataFrame, trained: bool = True, by_huffman: bool = True, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_symbols, bits, bpb, w_char, w_morph, w_struct): code length of each document's class stream
    under its own context model, in one pass over its tokens. trained: mixing weights as the document trains
    them, else equal ones; by_huffman: a sentence's structure is trusted by 2 to the minus its bits per tag,
    else by 1 / number of tags; with_bytes: also (bytes), the text's size. Documents without words have no symbols: 0 bits, and null bpb where the text
    is empty."""

    def one(m: streams.Marked, _share, _tokens, size: int) -> tuple:
        own = streams.Model(*m.counts())
        w = streams.fold(streams.winners(m, own)) if trained else streams.EVEN
        bits = streams.bits(m, own, w, by_huffman)
        return len(m), bits, bits / size if size else None, *w, size

    rows = streams.per_document(docs, "n_symbols long, bits double, bpb double, w_char double, w_morph double, w_struct double, bytes long", one)
    rows = rows if with_bytes else rows.drop("bytes")
    return rows.withColumns({"bits": F.round("bits", 4), "bpb": F.round("bpb", 4)})


def context_bits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_symbols, bits, bpb) with equal weights and structure weighted by 1 / number of tags: the
    form of document_bits that has SQL."""
    return document_bits(docs, trained=False, by_huffman=False).select("doc_id", "n_symbols", "bits", "bpb")


def unigram_bits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_symbols, bits) under the document's own add-one class frequencies."""
    n = joint(pairs(tokens(docs))).groupBy("doc_id", "cls").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("doc_id")
    p = (F.col("n") + 1) / (F.sum("n").over(w) + F.count("*").over(w))
    n = n.withColumn("b", -F.col("n") * F.log2(p))
    return n.groupBy("doc_id").agg(F.sum("n").alias("n_symbols"), F.round(F.sum("b"), 4).alias("bits"))


def best_stream(docs: DataFrame) -> DataFrame:
    """(doc_id, best array<int>): for each character after its sentence's first, in order, which of the
    three distributions gives it most (the first on ties)."""
    return streams.per_document(docs, "best array<int>", lambda m, *_: (streams.winners(m, streams.Model(*m.counts())).tolist(),)).where(F.size("best") > 0)


def mixing_weights(docs: DataFrame) -> DataFrame:
    """(doc_id, w_char, w_morph, w_struct) of documents with words."""
    return document_bits(docs).where("n_symbols > 0").select("doc_id", "w_char", "w_morph", "w_struct")


def mixing_weights_native(docs: DataFrame) -> DataFrame:
    """The same fold as one higher-order expression: a cross-check for short documents."""

    def step(w, b):
        raw = [F.when(b == i, w[i] + RATE).otherwise(F.greatest(w[i] - RATE / 2, F.lit(FLOOR))) for i in range(3)]
        return F.aggregate(F.array(F.array(*raw)), F.array().cast("array<double>"), lambda _, r: F.array(*[r[i] / (r[0] + r[1] + r[2]) for i in range(3)]))

    w = F.aggregate("best", F.array(*[F.lit(1 / 3)] * 3), step)
    return best_stream(docs).select("doc_id", w.alias("w")).select("doc_id", F.col("w")[0].alias("w_char"), F.col("w")[1].alias("w_morph"), F.col("w")[2].alias("w_struct"))


def global_distribution(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, p): add-one class frequencies over all morph contexts."""
    n = joint(pairs(tokens(docs))).groupBy("doc_id", "cls").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("doc_id")
    return n.select("doc_id", "cls", F.round((F.col("n") + 1) / (F.sum("n").over(w) + F.count("*").over(w)), 8).alias("p"))
