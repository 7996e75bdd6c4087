"""Documents as rows of sentences, tokens and character pairs.

Everything up to the pairs is a narrow projection: one scan, no shuffle. A sentence is never wider than
its document, so explosion keeps rows small."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import morph, phonetic, text
from glossa.functions.dims import TAG_SUFFIXES, TAGGER

_CUT = 500_000
_SENTENCE_END = re.compile(r"(?<=[.!?])(?<!\s)(?=\s)", re.ASCII)


def spread(docs: DataFrame) -> DataFrame:
    """Small files scan as few partitions; heavy projections want all cores. Keyed, so that later
    per-document aggregation needs no other exchange."""
    spark = docs.sparkSession
    # Spark 4.1 takes a union of children with equal hash partitioning as partitioned like them, also when
    # adaptive execution has coalesced only one; aggregates above it then count rows twice.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def chunks(docs: DataFrame, size: int = _CUT) -> DataFrame:
    """(doc_id, chunk_id, chunk): cut at the last line end before size characters, else at size; leading
    line ends of the rest are dropped. One pass a document by recursion over the rest of the text."""

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        head = F.left(rest, F.lit(size))
        back = F.instr(F.reverse(head), "\n")
        at = F.when((F.length(rest) <= size) | (back == 0) | (back == size), F.lit(size)).otherwise(size - back)
        more = F.regexp_replace(F.substring(rest, at + 1, F.lit(1 << 30)), "^\n+", "")
        done = F.length(rest) == 0
        return F.struct(F.when(done, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.substring(rest, F.lit(1), at)))).alias("out"), F.when(done, rest).otherwise(more).alias("rest"))

    t = F.coalesce("text", F.lit(""))
    rounds = F.sequence(F.lit(0), F.ceil(F.length(t) / size).cast("int") * 2)
    start = F.struct(F.array().cast("array<string>").alias("out"), t.alias("rest"))
    many = F.aggregate(rounds, start, step)["out"]
    parts = F.when(F.length(t) <= size, F.array(t)).otherwise(many)
    return docs.select("doc_id", F.posexplode(parts).alias("chunk_id", "chunk"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, sentence) of the normalised text."""
    return docs.select("doc_id", F.posexplode(text.sentences(text.normalised(F.col("text")))).alias("sent_id", "sentence"))


def cut_points(lengths: list[int], size: int) -> list[int]:
    """How many of the pieces each chunk takes: as many as fit in size, one at least."""
    out, total, n = [], 0, 0
    for k in lengths:
        if n and total and total + k > size:
            out.append(n)
            total, n = 0, 0
        total, n = total + k, n + 1
    return [*out, n] if n else out


def sentence_chunks(docs: DataFrame, size: int = 3000) -> DataFrame:
    """(doc_id, chunk_id, chunk_offset, chunk): whole sentences (cut after . ! ? and white space), as many
    as fit in size characters, one at least. A null or empty text is one empty chunk."""

    @F.pandas_udf("array<struct<chunk_offset:int,chunk:string>>")
    def chunked(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            # each piece keeps its leading white space, so pieces add up to the text
            pieces = [p for p in _SENTENCE_END.split(t) if p] or [""]
            at, k, rows = 0, 0, []
            for n in cut_points([len(p) for p in pieces], size):
                rows.append({"chunk_offset": at, "chunk": "".join(pieces[k : k + n])})
                at, k = at + len(rows[-1]["chunk"]), k + n
            out.append(rows)
        return pd.Series(out)

    rows = docs.select("doc_id", F.posexplode(chunked(F.coalesce("text", F.lit("")))).alias("chunk_id", "c"))
    return rows.select("doc_id", "chunk_id", "c.chunk_offset", "c.chunk")


def bare(word: Column) -> Column:
    """Lower case, without signs outside."""
    return F.regexp_extract(F.lower(word), r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", 0)


def tagged(word: Column, first: Column, w: Column | None = None) -> Column:
    """Default tag of a word: closed lists, digits, suffixes, capitals; else NOUN. w: the bare word, where it is
    a column already. A tagging model can take its place (see retagged)."""
    w = bare(word) if w is None else w
    c = F.when(w == "", "PUNCT").when(w.rlike("^[0-9]+([.,][0-9]+)*$"), "NUM")
    for tag, ws in TAGGER.items():
        c = c.when(w.isin(ws.split()), tag)
    for tag, ends in TAG_SUFFIXES.items():
        hit = F.lit(False)
        for e in ends:
            hit = hit | (w.endswith(e) & (F.length(w) >= len(e) + 2))
        c = c.when(hit, tag)
    return c.when(~first & word.rlike(r"^[^\p{L}\p{N}]*\p{Lu}"), "PROPN").otherwise("NOUN")


def tokens(docs: DataFrame, tagger: Callable[[], Callable[[list[list[str]]], list[list[str]]]] | None = None) -> DataFrame:
    """(doc_id, sent_id, tok_id, n_tok, word, root, code, tag). tagger: see retagged()."""
    s = sentences(docs).withColumn("ws", text.words(F.col("sentence")))
    t = s.select("doc_id", "sent_id", F.size("ws").alias("n_tok"), F.posexplode("ws").alias("tok_id", "word"))
    # columns of their own, as each is used several times
    t = t.withColumns({"m": morph.analysed(F.col("word")), "b": bare(F.col("word"))})
    t = t.select("doc_id", "sent_id", "tok_id", "n_tok", "word", F.col("m.root").alias("root"), F.col("m.code").alias("code"), tagged(F.col("word"), F.col("tok_id") == 0, F.col("b")).alias("tag"))
    return retagged(t, tagger) if tagger else t


def retagged(toks: DataFrame, make: Callable[[], Callable[[list[list[str]]], list[list[str]]]]) -> DataFrame:
    """Tokens with the tags of a model: make() loads it, once a task; it then takes sentences (lists of words)
    and gives their tags. Sentences go to it whole, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            b["r"] = [[{**x, "tag": t} for x, t in zip(r, tags, strict=True)] for r, tags in zip(b["r"], model([[x["word"] for x in r] for r in b["r"]]), strict=True)]
            yield b

    names = ["tok_id", "word", "root", "code", "tag"]
    s = toks.groupBy("doc_id", "sent_id", "n_tok").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("r"))
    return s.mapInPandas(run, s.schema).select("doc_id", "sent_id", "n_tok", F.explode("r").alias("x")).select("doc_id", "sent_id", "x.tok_id", "n_tok", *(f"x.{c}" for c in names[1:]))


def pairs(toks: DataFrame) -> DataFrame:
    """(doc_id, sent_id, tok_id, i, prev, cls, code, tag, opens): a row a character of the marked streams
    ^root$_^root$ with the class before it (0 at a document's start, else a sentence's last: 6); markers
    have code 0 and tag X; opens: first of its sentence; on a word's first marker, tok_code and tok_tag are
    the word's."""
    head = (F.col("tok_id") == 0) & (F.col("sent_id") == 0)
    before = F.when(head, "0").when(F.col("tok_id") == 0, "6").otherwise("5")
    body = F.concat(before, F.lit("6"), phonetic.class_string(F.col("root")), F.lit("6"), F.when(F.col("tok_id") < F.col("n_tok") - 1, "5").otherwise(""))
    n = F.length("root")
    rows = toks.select("doc_id", "sent_id", "tok_id", n.alias("n"), "code", "tag", F.posexplode(F.regexp_extract_all(body, F.lit("(?=(..))"), F.lit(1))).alias("i", "pc"))
    inner = (F.col("i") > 0) & (F.col("i") <= F.col("n"))
    return rows.select(
        "doc_id", "sent_id", "tok_id", "i",
        F.left("pc", F.lit(1)).cast("int").alias("prev"), F.right("pc", F.lit(1)).cast("int").alias("cls"),
        F.when(inner, F.col("code")).otherwise(0).alias("code"), F.when(inner, F.col("tag")).otherwise("X").alias("tag"),
        ((F.col("tok_id") == 0) & (F.col("i") == 0)).alias("opens"),
        F.when(F.col("i") == 0, F.col("code")).alias("tok_code"), F.when(F.col("i") == 0, F.col("tag")).alias("tok_tag"),
    )
