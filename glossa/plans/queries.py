"""The engine's named queries: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions import dims, morph, phonetic, text
from glossa.operators import codec, counted, discourse, model, relations, report, structure

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Integers as long, so that results don't depend on how a count was made."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(f.name) for f in df.schema.fields])


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _wide(f(spark, sf_dir))

    _ALL[f.__name__] = run
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def normalize(s, d):
    return documents(s, d).select("doc_id", text.normalised(F.col("text")).alias("norm"))


@query
def collapse_whitespace(s, d):
    return table(s, d, "pages").select("page_id", text.collapsed(text.without_bom(F.col("html"))).alias("line"))


@query
def sentences(s, d):
    return relations.sentences(documents(s, d))


@query
def sentence_counts(s, d):
    return report.sentence_counts(documents(s, d))


@query
def sentence_chunks(s, d):
    c = relations.sentence_chunks(documents(s, d))
    return c.groupBy("doc_id").agg(F.sum(F.length("chunk")).alias("n_chars"), F.max(F.when(F.col("chunk_offset") > 0, 1).otherwise(0)).alias("cut"))


@query
def text_chunks(s, d):
    return relations.chunks(documents(s, d)).select("doc_id", "chunk_id", F.length("chunk").alias("n_chars"))


@query
def tokens(s, d):
    return relations.tokens(documents(s, d)).select("doc_id", "sent_id", "tok_id", "word")


@query
def capitalise(s, d):
    return relations.sentences(documents(s, d)).select("doc_id", "sent_id", text.capitalised(text.lowered(F.col("sentence"))).alias("line"))


@query
def detokenise(s, d):
    t = documents(s, d).select("doc_id", text.words(text.normalised(F.col("text"))).alias("ws"))
    return t.select("doc_id", text.joined_words(F.col("ws")).alias("line"))


@query
def autocorrect(s, d):
    return documents(s, d).select("doc_id", text.autocorrected(F.col("text")).alias("line"))


@query
def morph_rule(s, d):
    return relations.tokens(documents(s, d)).select("doc_id", "sent_id", "tok_id", "root", "code")


@query
def morph_savings(s, d):
    return report.morph_savings(documents(s, d))


@query
def morph_code_hist(s, d):
    n = relations.tokens(documents(s, d)).groupBy("code").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(dims.morph_table(s)), "code").select("code", "name", "n")


@query
def morph_inverse(s, d):
    t = relations.tokens(documents(s, d)).select("root", "code").distinct()
    return t.select("root", "code", morph.applied(F.col("root"), F.col("code")).alias("surface"))


@query
def phonetic_triples(s, d):
    w = relations.tokens(documents(s, d)).groupBy("root").agg(F.count("*").alias("n"))
    c = w.select("n", F.explode(phonetic.triples(F.col("root"))).alias("t"))
    return c.groupBy(F.col("t.cls").alias("cls"), F.col("t.pos").alias("pos"), F.col("t.role").alias("role")).agg(F.sum("n").alias("n"))


@query
def char_deltas(s, d):
    w = relations.tokens(documents(s, d)).groupBy("root").agg(F.count("*").alias("n"))
    t = w.select("n", phonetic.triples(F.col("root")).alias("t"))
    both = t.select("n", F.explode(F.arrays_zip(phonetic.deltas(F.col("t.cls")).alias("c"), phonetic.deltas(F.col("t.pos")).alias("p"))).alias("x"))
    return both.groupBy(F.col("x.c").alias("d_cls"), F.col("x.p").alias("d_pos")).agg(F.sum("n").alias("n"))


@query
def order_deltas(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    q = F.col("l_quantity")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (q - F.coalesce(F.lag(q).over(w), F.lit(0.0))).alias("delta"))


@query
def prefix_sum_roundtrip(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    q = F.col("l_quantity")
    x = table(s, d, "lineitem").withColumn("delta", q - F.coalesce(F.lag(q).over(w), F.lit(0.0)))
    x = x.withColumn("back", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum((F.abs(F.col("back") - q) < 1e-9).cast("int")).alias("n_ok"))


@query
def factoradic(s, d):
    f = phonetic.factoradic(F.col("p_partkey"))
    return table(s, d, "part").select("p_partkey", F.array_join(f.cast("array<string>"), ".").alias("digits"), phonetic.from_factoradic(f).alias("back"), F.round(report.factoradic_bits(F.size(f)), 6).alias("bits"))


@query
def delta_stats(s, d):
    return report.delta_stats(documents(s, d))


def _toks(s, d):
    return relations.tokens(documents(s, d))


@query
def bigram_counts(s, d):
    return counted.char_context(documents(s, d))


@query
def morph_context(s, d):
    return counted.morph_context(documents(s, d))


@query
def struct_context(s, d):
    return counted.struct_context(documents(s, d))


@query
def vocabularies(s, d):
    return counted.vocabularies(documents(s, d))


@query
def smoothed_dist(s, d):
    return counted.smoothed(documents(s, d)).withColumn("p", F.round("p", 8))


@query
def struct_char_dist(s, d):
    return counted.by_tag(documents(s, d)).withColumn("p", F.round("p", 8))


@query
def unigram_bits(s, d):
    return counted.unigram_bits(documents(s, d))


@query
def global_char_dist(s, d):
    n = counted.class_counts(documents(s, d))
    return n.select("doc_id", "cls", F.round((F.col("n") + 1) / (F.col("total") + F.col("kinds")), 8).alias("p"))


@query
def context_bpb(s, d):
    return model.context_bits(documents(s, d))


@query
def mixing_weights(s, d):
    w = model.mixing_weights(documents(s, d))
    return w.select("doc_id", *[F.round(c, 8).alias(c) for c in ("w_char", "w_morph", "w_struct")])


@query
def pos_freq(s, d):
    return counted.pos_frequencies(documents(s, d))


@query
def huffman_codes(s, d):
    return structure.huffman_codes(structure.pos_frequencies(_toks(s, d)))


@query
def huffman_summary(s, d):
    return structure.huffman_summary(documents(s, d))


@query
def huffman_sentences(s, d):
    return counted.huffman_sentences(documents(s, d)).select("doc_id", "sent_id", "n_tags", (F.length("bitstring") == F.col("n_bits")).alias("ok"))


@query
def tag_deltas(s, d):
    return counted.tag_deltas(documents(s, d))


@query
def first_seen_ids(s, d):
    return counted.first_seen_ids(documents(s, d))


@query
def noun_phrases(s, d):
    return counted.noun_phrases(documents(s, d))


@query
def sentence_type(s, d):
    return structure.sentence_meta(documents(s, d))


@query
def sentence_voice(s, d):
    t = _toks(s, d).groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("tok_id", "word", "tag"))).alias("r"))
    return t.select("doc_id", "sent_id", structure.rule_voice(F.col("r.tag"), F.col("r.word")).alias("voice"))


@query
def connectives(s, d):
    return counted.connectives(documents(s, d))


@query
def relation_counts(s, d):
    return counted.connectives(documents(s, d)).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query
def entity_chains(s, d):
    return discourse.chains(documents(s, d))


@query
def symbol_roundtrip(s, d):
    return discourse.symbol_report(documents(s, d)).select("doc_id", "ok", "n_words_before")


@query
def symbol_encode(s, d):
    return discourse.encoded_symbols(documents(s, d)).select("doc_id", "encoded", "n_symbols")


@query
def relation_symbols(s, d):
    e = discourse.encoded_symbols(documents(s, d), with_relations=True)
    return e.select("doc_id", (F.col("original") == F.col("decoded")).alias("ok"))


@query
def word_symbols(s, d):
    return discourse.word_symbols(documents(s, d))


@query
def transition_graph(s, d):
    return report.transition_graph(documents(s, d))


@query
def symbol_ids(s, d):
    return report.symbol_ids(report.transition_graph(documents(s, d)))


@query
def greedy_walk(s, d):
    return report.greedy_walk(report.transition_graph(documents(s, d)))


@query
def transition_bits(s, d):
    g = report.transition_graph(documents(s, d))
    line = table(s, d, "conversations").select("conv_id", "turn", F.explode(text.words(F.regexp_replace(F.lower("text"), r"[^\w\s]+", "."))).alias("w"))
    pairs = line.select("conv_id", "turn", F.explode(F.regexp_extract_all(F.concat(F.lit("^"), F.col("w"), F.lit("$")), F.lit("(?=(..))"), F.lit(1))).alias("pc"))
    pairs = pairs.select("conv_id", "turn", F.left("pc", F.lit(1)).alias("cur"), F.right("pc", F.lit(1)).alias("nxt"))
    return report.char_bits(g, pairs).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.round(F.sum("bits"), 3).alias("bits"))


@query
def arith_roundtrip(s, d):
    return codec.arithmetic_round_trip(documents(s, d)).select("doc_id", "n_symbols", "ok", "near_ideal")


@query
def counts_roundtrip(s, d):
    return codec.counts_round_trip(documents(s, d)).select("doc_id", "n_symbols", "ok", "near_ideal")


@query
def rans_roundtrip(s, d):
    return codec.rans_round_trip(documents(s, d)).select("doc_id", "n_symbols", "ok", "near_ideal")


@query
def payload_roundtrip(s, d):
    return codec.words_returned(codec.rebuilt(codec.payload(documents(s, d), with_words=True)))


@query
def model_bpb(s, d):
    m = model.document_bits(documents(s, d))
    return m.select("doc_id", "n_symbols", "bits", "bpb")


@query
def compress_payload(s, d):
    c = codec.compressed(documents(s, d))
    return c.select("doc_id", "original_bytes", "n_words", "n_symbols", (F.col("archive_bytes") > 0).alias("coded"), F.col("error").isNotNull().alias("failed"))


@query
def decompress_roundtrip(s, d):
    c = codec.compressed(documents(s, d), "words array<string>", lambda _, share, t: (share.surface(t).to_pylist(),))
    return codec.words_returned(codec.decompressed(c))


@query
def evaluation_rows(s, d):
    return report.evaluation(documents(s, d)).drop("seconds")


@query
def evaluation_summary(s, d):
    return report.evaluation_summary(report.evaluation(documents(s, d))).drop("seconds")


@query
def root_characters(s, d):
    return counted.returned(counted.roots(documents(s, d)), "")


@query
def word_decode(s, d):
    return counted.returned(counted.roots(documents(s, d)), "?")


@query
def sentence_streams(s, d):
    return counted.sentence_streams(documents(s, d))


@query
def syntax_result(s, d):
    return counted.syntax(documents(s, d))


@query
def morph_digits(s, d):
    f = phonetic.factoradic(F.col("code"))
    return dims.morph_table(s).select("code", "name", F.array_join(f.cast("array<string>"), ".").alias("digits"), phonetic.from_factoradic(f).alias("back"))


@query
def split_roots(s, d):
    t = _toks(s, d).groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("tok_id", "root"))).alias("r"))
    line = F.array_join(F.transform("r.root", lambda r: F.concat(F.lit("^"), r, F.lit("$"))), "_")
    return t.select("doc_id", "sent_id", F.array_join(F.regexp_extract_all(line, F.lit(r"\^([^$^]+)\$"), F.lit(1)), " ").alias("roots"))


@query
def tag_lz77(s, d):
    t = _toks(s, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_id", "tok_id", "tag"))).alias("r"))
    return codec.tag_round_trip(t.select("doc_id", F.col("r.tag").alias("tags"))).select("doc_id", "n_tags", "ok")


@query
def word_substitution(s, d):
    w = discourse.word_substituted(documents(s, d))
    return w.select("doc_id", "n_symbols", (F.col("original") == F.col("decoded")).alias("ok"))


@query
def slot_splice(s, d):
    return discourse.slotted(documents(s, d)).select("doc_id", "ok")


@query
def corpus_summary(s, d):
    return report.corpus_summary(documents(s, d))


@query
def bpb_by_lang(s, d):
    return report.bits_by(relations.spread(table(s, d, "documents").select("doc_id", "text", "lang")), "lang")


@query
def bpb_by_label(s, d):
    b = model.context_bits(documents(s, d))
    lab = table(s, d, "labels").select("doc_id", "quality", "toxic")
    return b.join(lab, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n_docs"), F.round(F.avg("bpb"), 3).alias("mean_bpb"))


@query
def sample_docs(s, d):
    t = report.sample(table(s, d, "documents"), 50, 5000)
    return t.select("doc_id", F.length("text").alias("n_chars"))


@query
def alphabets(s, d):
    return dims.alphabet(s)


@query
def coordinates(s, d):
    return dims.coordinates_table(s)


def queries() -> dict[str, Query]:
    return dict(_ALL)
