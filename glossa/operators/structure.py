"""Sentence structure: types, voice, tags, tag codes, tree shapes, phrases."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import phonetic
from glossa.functions.dims import POS_TAGS, SENTENCE_TYPES
from glossa.operators.relations import sentences, tokens

PASSIVE = ("nsubjpass", "nsubj:pass", "auxpass", "aux:pass")


def sentence_type(sentence: Column, dep_labels: Column | None = None, pos_tags: Column | None = None) -> Column:
    """? -> INTERROGATIVE, ! -> EXCLAMATORY, a ROOT verb without a subject -> IMPERATIVE (where labels are
    given), else DECLARATIVE."""
    s = F.rtrim(sentence)
    c = F.when(s.endswith("?"), "INTERROGATIVE").when(s.endswith("!"), "EXCLAMATORY")
    if dep_labels is not None and pos_tags is not None:
        verb = F.exists(F.arrays_zip(dep_labels.alias("d"), pos_tags.alias("p")), lambda x: (x["d"] == "ROOT") & (x["p"] == "VERB"))
        c = c.when(verb & ~F.arrays_overlap(dep_labels, F.array(F.lit("nsubj"), F.lit("nsubjpass"))), "IMPERATIVE")
    return c.otherwise("DECLARATIVE")


def voice(dep_labels: Column) -> Column:
    return F.when(F.arrays_overlap(dep_labels, F.array(*map(F.lit, PASSIVE))), "PASSIVE").otherwise("ACTIVE")


def rule_voice(tags: Column, words: Column) -> Column:
    """Voice without a parser: a form of to be, then (an adverb and) a word in -ed or -en."""
    return F.when(F.array_join(words, " ").rlike(r"(?i)(^|[^A-Za-z0-9_])(is|are|was|were|be|been|being) ([A-Za-z0-9_]+ly )?[A-Za-z0-9_]+(ed|en)([^A-Za-z0-9_]|$)"), "PASSIVE").otherwise("ACTIVE")


def meta_code(kind: Column, voice: Column) -> Column:
    """struct(type 0-3, voice 0-1); anything unknown is 0."""
    t = F.coalesce(F.array_position(F.array(*map(F.lit, SENTENCE_TYPES)), kind), F.lit(0))
    return F.struct(F.greatest(t - 1, F.lit(0)).cast("int").alias("type"), (voice == "PASSIVE").cast("int").alias("voice"))


def meta_name(code: Column) -> Column:
    names = F.array(*map(F.lit, SENTENCE_TYPES))
    return F.struct(F.coalesce(F.try_element_at(names, code["type"] + 1), F.lit(SENTENCE_TYPES[0])).alias("type"), F.when(code["voice"] == 1, "PASSIVE").otherwise("ACTIVE").alias("voice"))


def sentence_meta(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, type, type_code)."""
    s = sentences(docs).withColumn("type", sentence_type(F.col("sentence")))
    return s.select("doc_id", "sent_id", "type", meta_code(F.col("type"), F.lit("ACTIVE"))["type"].alias("type_code"))


def syntax(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, sentence, tokens, tags, sentence_type, voice, phrases): what is known of each sentence
    with words; phrases: array<struct<start,end,label>>."""
    t = tokens(docs)
    s = t.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("tok_id", "word", "tag"))).alias("r"))
    np_ = noun_phrases(t).groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("phrases"))
    j = sentences(docs).join(s, ["doc_id", "sent_id"]).join(np_, ["doc_id", "sent_id"], "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string>>")
    return j.select(
        "doc_id", "sent_id", "sentence", F.col("r.word").alias("tokens"), F.col("r.tag").alias("tags"), sentence_type(F.col("sentence")).alias("sentence_type"),
        rule_voice(F.col("r.tag"), F.col("r.word")).alias("voice"), F.coalesce(F.col("phrases").cast("array<struct<start:bigint,end:bigint,label:string>>"), none).alias("phrases"),
    )


def sentence_streams(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, classes, places, codes, tags, root_lengths, class_deltas, place_deltas, type, voice): all
    streams of each sentence's marked words as arrays; classes and places are a number a character."""
    s = tokens(docs).groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("tok_id", "word", "root", "code", "tag"))).alias("r"))
    line = F.array_join(F.transform("r.root", lambda r: F.concat(F.lit("^"), r, F.lit("$"))), "_")
    s = s.withColumns({"k": phonetic.characters(phonetic.class_string(line)), "p": phonetic.characters(phonetic.place_string(line))})
    s = s.withColumns({"classes": F.transform("k", lambda c: c.cast("int")), "places": F.transform("p", lambda c: F.ascii(c) - 48)})
    meta = sentences(docs).select("doc_id", "sent_id", sentence_type(F.col("sentence")).alias("type"))
    return s.join(meta, ["doc_id", "sent_id"]).select(
        "doc_id", "sent_id", "classes", "places", F.col("r.code").alias("codes"), F.col("r.tag").alias("tags"), F.transform("r.root", F.length).alias("root_lengths"),
        phonetic.deltas(F.col("classes")).alias("class_deltas"), phonetic.deltas(F.col("places")).alias("place_deltas"), "type", rule_voice(F.col("r.tag"), F.col("r.word")).alias("voice"),
    )


def tree_shape(heads: list[int], deps: list[str]) -> str:
    """S[dep[child ...]] of a dependency tree: children by index, a node met again is *, no node is S[]."""
    kids: dict[int, list[int]] = {}
    roots = []
    for i, h in enumerate(heads):
        (roots if h == i or h < 0 else kids.setdefault(h, [])).append(i)
    if not roots:
        return "S[]"
    seen: set[int] = set()
    parts: list[str] = []
    stack: list[int | str] = [roots[0]]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x in seen:
            parts.append("*")
        else:
            seen.add(x)
            parts.append(deps[x])
            below = kids.get(x, [])
            if below:
                parts.append("[")
                stack.append("]")
                for n, k in enumerate(reversed(below)):
                    stack.append(k)
                    if n < len(below) - 1:
                        stack.append(" ")
    return "S[" + "".join(parts) + "]"


def tree_shapes(parsed: DataFrame) -> DataFrame:
    """(..., heads array<int>, deps array<string>) with the column shape, in Arrow batches."""

    @F.pandas_udf("string")
    def shape(heads: pd.Series, deps: pd.Series) -> pd.Series:
        return pd.Series([tree_shape(list(h), list(d)) for h, d in zip(heads, deps, strict=True)], dtype="object")

    return parsed.withColumn("shape", shape("heads", "deps"))


def first_seen_ids(rows: DataFrame, key: str, order: list[str], symbol: str) -> DataFrame:
    """(key, symbol, id): ids from 0 by first occurrence within each key."""
    first = rows.groupBy(key, symbol).agg(F.min(F.struct(*order)).alias("at"))
    return first.select(key, symbol, (F.row_number().over(Window.partitionBy(key).orderBy("at", symbol)) - 1).alias("id"))


def noun_phrases(toks: DataFrame) -> DataFrame:
    """(doc_id, sent_id, start, end, label): maximal runs DET? (ADJ|NUM)* (NOUN|PROPN)+ of the tags."""
    letter = F.create_map(*[F.lit(x) for i, t in enumerate(POS_TAGS) for x in (t, chr(97 + i))])
    s = toks.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("tok_id", "tag"))).alias("r"))
    code = {t: chr(97 + i) for i, t in enumerate(POS_TAGS)}
    pattern = f"{code['DET']}?[{code['ADJ']}{code['NUM']}]*[{code['NOUN']}{code['PROPN']}]+"
    s = s.withColumn("line", F.array_join(F.transform("r", lambda x: letter[x["tag"]]), ""))
    found = s.select("doc_id", "sent_id", F.regexp_extract_all("line", F.lit(f"({pattern})"), F.lit(1)).alias("np"), F.split("line", pattern).alias("gap"))
    rows = found.select("doc_id", "sent_id", F.posexplode(F.arrays_zip(F.col("gap").alias("gap"), F.col("np").alias("np"))).alias("k", "x")).where("x.np is not null")
    before = Window.partitionBy("doc_id", "sent_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("x.gap") + F.length("x.np")).over(before)
    rows = rows.select("doc_id", "sent_id", end.alias("stop"), F.length("x.np").alias("n"))
    return rows.select("doc_id", "sent_id", (F.col("stop") - F.col("n")).alias("start"), (F.col("stop") - 1).alias("end"), F.lit("NP").alias("label"))


def pos_frequencies(toks: DataFrame) -> DataFrame:
    """(doc_id, tag, n, first): counts in the document and where the tag came first."""
    return toks.groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.min(F.struct("sent_id", "tok_id")).alias("first"))


def huffman(counts: list[tuple[str, int]]) -> dict[str, str]:
    """Codes for symbols in order of first occurrence: of equal weights the earlier made node goes first,
    the first of two gets 0; a single symbol gets '0'."""
    if len(counts) == 1:
        return {counts[0][0]: "0"}
    heap: list[tuple[int, int, list[str]]] = [(n, i, [s]) for i, (s, n) in enumerate(counts)]
    heapq.heapify(heap)
    bits = {s: "" for s, _ in counts}
    made = len(heap)
    while len(heap) > 1:
        low, high = heapq.heappop(heap), heapq.heappop(heap)
        for node, bit in ((low, "0"), (high, "1")):
            for s in node[2]:
                bits[s] = bit + bits[s]
        heapq.heappush(heap, (low[0] + high[0], made, low[2] + high[2]))
        made += 1
    return bits


def huffman_codes(freq: DataFrame) -> DataFrame:
    """(doc_id, tag, n, bits): one code book a document (17 tags at most), made once and joined, not a
    sentence at a time."""
    books = freq.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "tag", "n"))).alias("r")).select("doc_id", F.col("r.tag").alias("tags"), F.col("r.n").alias("ns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, tags, ns in zip(b["doc_id"], b["tags"], b["ns"], strict=True):
                book = huffman(list(zip(tags, (int(n) for n in ns), strict=True)))
                rows += [(d, t, int(n), book[t]) for t, n in zip(tags, ns, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "tag", "n", "bits"])

    return books.mapInPandas(run, "doc_id long, tag string, n long, bits string")


def encoded_tags(toks: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc_id, sent_id, bitstring, n_bits, n_tags)."""
    j = toks.join(codes.select("doc_id", "tag", "bits"), ["doc_id", "tag"])
    s = j.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("tok_id", "bits"))).alias("r"))
    return s.select("doc_id", "sent_id", F.array_join("r.bits", "").alias("bitstring"), F.aggregate("r.bits", F.lit(0), lambda a, x: a + F.length(x)).alias("n_bits"), F.size("r").alias("n_tags"))


def decoded_tags(bits: str, book: dict[str, str]) -> list[str]:
    """Greedy decoding of a prefix code."""
    back, out, cur = {v: k for k, v in book.items()}, [], ""
    for b in bits:
        cur += b
        if cur in back:
            out.append(back[cur])
            cur = ""
    return out


def huffman_summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_tags, n_symbols, huffman_bits, flat_bits, saved_bits, bits_per_tag), from one
    count of tags a sentence."""
    t = tokens(docs).groupBy("doc_id", "sent_id", "tag").agg(F.count("*").alias("n"), F.min("tok_id").alias("tok_id"))
    f = t.groupBy("doc_id", "tag").agg(F.sum("n").alias("n"), F.min(F.struct("sent_id", "tok_id")).alias("first"), F.collect_set("sent_id").alias("in"))
    books = f.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "tag", "n"))).alias("r"), F.size(F.array_distinct(F.flatten(F.collect_list("in")))).alias("n_sentences"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, n_sentences, tags, ns in b.itertuples(index=False):
                counts = list(zip(tags, (int(n) for n in ns), strict=True))
                book = huffman(counts)
                rows.append((d, n_sentences, sum(n for _, n in counts), len(counts), sum(n * len(book[t]) for t, n in counts)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_sentences", "n_tags", "n_symbols", "huffman_bits"])

    rows = books.select("doc_id", F.col("n_sentences").cast("long"), F.col("r.tag").alias("tags"), F.col("r.n").alias("ns"))
    total = rows.mapInPandas(run, "doc_id long, n_sentences long, n_tags long, n_symbols long, huffman_bits long")
    flat = F.col("n_tags") * F.when(F.col("n_symbols") > 1, F.ceil(F.log2("n_symbols"))).otherwise(1)
    return total.select(
        "*", flat.cast("long").alias("flat_bits"), (flat - F.col("huffman_bits")).cast("long").alias("saved_bits"), F.round(F.col("huffman_bits") / F.col("n_tags"), 6).alias("bits_per_tag"),
    )


def tag_deltas(toks: DataFrame) -> DataFrame:
    """(doc_id, sent_id, tok_id, tag_id, delta): first-seen tag ids and their differences in a sentence."""
    ids = first_seen_ids(toks, "doc_id", ["sent_id", "tok_id"], "tag").withColumnRenamed("id", "tag_id")
    w = Window.partitionBy("doc_id", "sent_id").orderBy("tok_id")
    j = toks.join(ids, ["doc_id", "tag"])
    return j.select("doc_id", "sent_id", "tok_id", "tag_id", (F.col("tag_id") - F.coalesce(F.lag("tag_id").over(w), F.lit(0))).alias("delta"))
