"""Plain word rules against the column expressions."""

import random

from pyspark.sql import functions as F

from glossa.functions import dims, morph, words
from glossa.operators import codec, relations

ODD = "İstanbul ΣΟΦΟΣ Straße ßa Ünder 日本語 Ⅷx x² ½ ٣٤ ﬁn ǅabc Éa «Éa» $5 7€ 1,000.5 1. .5 un una unn bing ing sing ed bed need ied died tied ies dies ties es xes ches s as ly fly holly sly est best nest happiest er her bigger happier running stopped ☃ ☃ed aaing ——  ^ $ _ § I'm O'Neil don't --A 'A 1A a1 A1 ªa".split()


def test_same_as_columns(spark):
    rng = random.Random(5)
    ends = ["", "s", "es", "ies", "ed", "ied", "ing", "ly", "er", "est", "y", "le", "e", "ness", "ous", "ize"]
    made = ["".join(rng.choices("aeioubdgtnkxzshcryé", k=rng.randint(0, 4))) + rng.choice(ends) for _ in range(2000)]
    fixed = [w for d in (dims.IRREGULAR, dims.COMPARATIVES, dims.SUPERLATIVES) for kv in d.items() for w in kv] + dims.IDENTITY + " ".join(dims.TAGGER.values()).split()
    every = sorted({x for w in [*ODD, *made, *fixed] if w for x in (w, w.capitalize(), w.upper(), f"({w},")})
    t = spark.createDataFrame([(w,) for w in every], "word string").withColumn("m", morph.analysed(F.col("word"))).withColumn("b", relations.bare(F.col("word")))
    back = [morph.applied(F.col("m.root"), F.lit(k)).alias(f"a{k}") for k in range(13)]
    t = t.select("word", "m.root", "m.code", "b", relations.tagged(F.col("word"), F.lit(True)).alias("t0"), relations.tagged(F.col("word"), F.lit(False)).alias("t1"), codec.known_only(F.col("m.root")).alias("k"), *back)
    for r in t.collect():
        b = words.bare(r.word)
        assert (r.root, r.code, r.b) == (*words.analysed(r.word), b)
        assert (r.t0, r.t1) == tuple(dims.POS_TAGS[i] for i in words.tagged(r.word, b)), r.word
        assert r.k == words.known_only(r.root)
        assert [r[f"a{k}"] for k in range(13)] == [words.applied(r.root, k) for k in range(13)], r.root


def test_capital_of_every_letter(spark):
    """A first letter's capital is one character, as in SQL, also where full case mapping gives two.
    Left out: letters whose capitals came with Unicode 16, which DuckDB lacks."""
    import duckdb

    from glossa.functions import text

    table = duckdb.sql("SELECT chr(i::INTEGER) AS c, upper(chr(i::INTEGER)) || 'ßx' AS want FROM range(33, 65536) t(i) WHERE i NOT BETWEEN 55296 AND 57343 AND i NOT IN (411, 612, 7306, 42957, 42971)").fetchall()
    got = spark.createDataFrame(table, "c string, want string").withColumn("got", text.capitalised(F.concat("c", F.lit("ßx")))).where("got <> want").collect()
    assert not got
    low = duckdb.sql("SELECT chr(i::INTEGER) || 'AΣ' AS c, lower(chr(i::INTEGER) || 'AΣ') AS want FROM range(33, 1500) t(i)").fetchall()
    assert not spark.createDataFrame(low, "c string, want string").where(text.lowered(F.col("c")) != F.col("want")).collect()
    assert spark.createDataFrame([("",), (None,)], "c string").select(text.capitalised(F.col("c")).alias("x")).collect() == [("",), (None,)]
