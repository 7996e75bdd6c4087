"""Discourse: connectives, chains of repeated names, symbol substitution and its inverse."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text
from glossa.functions.dims import BOILERPLATE, CONNECTIVES, PRONOUNS, connectives_table
from glossa.operators.relations import bare, sentences, tokens

_NAME = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*(?![\p{L}\p{N}])"


def connectives(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, tok_id, connective, relation): one-word connectives, then longer ones, each found
    by equality of word n-grams with a broadcast table of 41 rows."""
    table = F.broadcast(connectives_table(docs.sparkSession))
    t = tokens(docs).select("doc_id", "sent_id", "tok_id", bare(F.col("word")).alias("w"))
    w = Window.partitionBy("doc_id", "sent_id").orderBy("tok_id")
    two, three = F.lead("w", 1).over(w), F.lead("w", 2).over(w)
    grams = t.select("doc_id", "sent_id", "tok_id", F.array(F.col("w"), F.concat_ws(" ", F.when(two.isNotNull(), F.col("w")), two), F.when(three.isNotNull(), F.concat_ws(" ", "w", two, three))).alias("g"))
    rows = grams.select("doc_id", "sent_id", "tok_id", F.posexplode("g").alias("k", "connective")).where("connective is not null and (k > 0 or connective <> '')")
    return rows.join(table, (rows.connective == table.connective) & (rows.k + 1 == table.n_words)).select("doc_id", "sent_id", "tok_id", rows.connective, "relation")


def names_inside(t: Column) -> Column:
    """Distinct capitalised words and rows of them that stand inside a sentence at least once."""
    # with what stands before it: a name at a sentence's start has nothing, and takes its later words along
    every = F.regexp_extract_all(t, F.lit(r"(?:[\p{Ll},;:] )?" + _NAME), F.lit(0))
    return F.array_distinct(F.transform(F.filter(every, lambda x: x.rlike(r"^[\p{Ll},;:] ")), lambda x: F.substring(x, 3, 1 << 30)))


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, surface, start): names_inside() at all their places, also at a sentence's start (the default
    resolver: a model's mentions can take their place)."""
    s = docs.select("doc_id", text.normalised(F.col("text")).alias("t"))
    named = s.select("doc_id", F.explode(names_inside(F.col("t"))).alias("surface"), "t")
    return named.select("doc_id", "surface", F.explode(occurrences(F.col("t"), F.col("surface"))).alias("start"))


def _word_at(t: str, i: int) -> bool:
    c = t[i : i + 1]
    return c.isalnum() or c == "_"


def places_of(t: str, surface: str, whole: bool = False) -> list[int]:
    """Places (from 0) of a literal that no word character follows, nor an apostrophe and one; whole: nor stands
    one before it."""
    out, n, i = [], len(surface), t.find(surface)
    while i >= 0:
        j = i + n
        if _word_at(t, j) or t[j : j + 1] in ("'", "’", "‘") and _word_at(t, j + 1) or whole and i and _word_at(t, i - 1):
            j = i + 1
        else:
            out.append(i)
        i = t.find(surface, j)
    return out


def occurrences(t: Column, surface: Column) -> Column:
    """places_of() in Arrow batches."""

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([places_of(x, y) for x, y in zip(texts, names, strict=True)], dtype="object")

    return found(t, surface)


def is_pronoun(surface: Column) -> Column:
    return F.lower(F.trim(surface)).isin(PRONOUNS)


def worthy(m: DataFrame, key: list[str]) -> DataFrame:
    """Keys of chains worth coding: two mentions or more, at most half of them boilerplate, 25 characters
    or less on average."""
    low = F.lower(F.trim("surface"))
    plate = F.lit(False)
    for term in BOILERPLATE:
        plate = plate | low.contains(term)
    g = m.groupBy(*key).agg(F.count("*").alias("n"), F.avg(F.length(low)).alias("mean_len"), F.avg(plate.cast("double")).alias("plate"))
    return g.where("n >= 2 and plate <= 0.5 and mean_len <= 25")


def chained(t: str, names: list[str]) -> list[tuple[str, list[int]]]:
    """Surfaces worth coding (as in worthy(), and no pronouns) with their places, by the first one."""
    out = []
    for surface in names:
        low = surface.lower()
        if low in PRONOUNS or len(low) > 25 or any(term in low for term in BOILERPLATE):
            continue
        at = places_of(t, surface)
        if len(at) > 1:
            out.append((at[0], surface, at))
    return [(surface, at) for _, surface, at in sorted(out)]


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, original, names): a text and its names_inside(), in one row."""
    n = docs.select("doc_id", text.normalised(F.col("text")).alias("original"))
    return n.select("doc_id", "original", names_inside(F.col("original")).alias("names"))


def chains(docs: DataFrame) -> DataFrame:
    """(doc_id, entity_id, surface, n_mentions): ids from 0 by first mention, unique in the document. A text meets its
    names in its own row: it is not copied for each of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, surface, len(at)) for d, t, names in b.itertuples(index=False) for i, (surface, at) in enumerate(chained(t, names))]
            yield pd.DataFrame(rows, columns=["doc_id", "entity_id", "surface", "n_mentions"])

    return _named(docs).mapInPandas(run, "doc_id long, entity_id int, surface string, n_mentions long")


def symbol_table(chain: DataFrame) -> DataFrame:
    """(doc_id, symbols map<string,string>)."""
    return chain.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("§E"), F.col("entity_id").cast("string")), "surface")))).alias("symbols"))


def substitute(t: str, table: list[tuple[int, str]], relations: list[tuple[int, str]] = []) -> str:  # noqa: B006
    """All mentions but the first of each surface as §E<id>; and every connective as §R<id>; with overlaps
    to the earlier start, then the longer surface; a § of the text itself is doubled."""
    found = []
    for kind, entries, keep in (("E", table, 1), ("R", relations, 0)):
        for i, surface in entries:
            at = places_of(t, surface, not keep)
            found += [(a, -len(surface), f"§{kind}{i};") for a in at[keep:]]
    out, last = [], 0
    for a, n, symbol in sorted(found):
        if a >= last:
            out += [t[last:a].replace("§", "§§"), symbol]
            last = a - n
    return "".join([*out, t[last:].replace("§", "§§")])


def restore(t: str, table: list[tuple[int, str]], relations: list[tuple[int, str]] = []) -> str:  # noqa: B006
    names = {("E", i): s for i, s in table} | {("R", i): s for i, s in relations}
    return re.sub(r"§(?:(§)|([ER])(\d+);)", lambda m: "§" if m[1] else names[m[2], int(m[3])], t)


def encoded_symbols(docs: DataFrame, with_relations: bool = False) -> DataFrame:
    """(doc_id, original, encoded, decoded, n_symbols): substitution and its inverse, in Arrow batches; with
    relations, connectives of two letters or more get symbols too."""
    words = [c for cs in CONNECTIVES.values() for c in cs] if with_relations else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tables = [[(i, surface) for i, (surface, _) in enumerate(chained(t, names))] for t, names in zip(b["original"], b["names"], strict=True)]
            used = [[(i, w) for i, w in enumerate(words) if w in t] for t in b["original"]]
            enc = [substitute(*x) for x in zip(b["original"], tables, used, strict=True)]
            dec = [restore(*x) for x in zip(enc, tables, used, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "original": b["original"], "encoded": enc, "decoded": dec, "n_symbols": [len(t) + len(r) for t, r in zip(tables, used, strict=True)]})

    return _named(docs).mapInPandas(run, "doc_id long, original string, encoded string, decoded string, n_symbols long")


def symbol_report(docs: DataFrame) -> DataFrame:
    """(doc_id, ok, n_words_before, n_words_after, first_mismatch): does decoding give the text back?"""
    e = encoded_symbols(docs)
    a, b = text.words(F.col("original")), text.words(F.col("decoded"))
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return e.select("doc_id", (F.col("original") == F.col("decoded")).alias("ok"), F.size(a).alias("n_words_before"), F.size(text.words(F.col("encoded"))).alias("n_words_after"), (differs - 1).alias("first_mismatch"))


def word_symbols(docs: DataFrame, table_cost: int = 20, symbol_len: int = 4) -> DataFrame:
    """(doc_id, word, n, net_saving): words worth a symbol: n uses save n * (length - symbol_len), an entry
    costs table_cost plus the word."""
    w = sentences(docs).select("doc_id", F.explode(text.words(F.col("sentence"))).alias("w")).select("doc_id", bare(F.col("w")).alias("word")).where("word <> ''")
    n = w.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return n.select("doc_id", "word", "n", (F.col("n") * (F.length("word") - symbol_len) - table_cost).alias("net_saving")).where("net_saving > 0")


def word_substituted(docs: DataFrame, table_cost: int = 20, symbol_len: int = 4) -> DataFrame:
    """(doc_id, original, encoded, decoded, n_symbols, saved): every word of word_symbols() replaced, whole and
    in the case in which it stands in its list, by §W<id>; and back. saved: characters of the text less those
    of the encoded one and the table's."""
    w = word_symbols(docs, table_cost, symbol_len)
    table = w.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("net_saving")).alias("k"), "word"))).alias("r")).select("doc_id", F.col("r.word").alias("words"))
    j = docs.select("doc_id", text.normalised(F.col("text")).alias("original")).join(table, "doc_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t, words in b.itertuples(index=False):
                names = list(enumerate(words)) if words is not None else []
                e = with_words(t, names)
                rows.append((d, t, e, re.sub(r"§(?:(§)|W(\d+);)", lambda m, x=dict(names): "§" if m[1] else x[int(m[2])], e), len(names), len(t) - len(e) - sum(len(w) + table_cost for _, w in names)))
            yield pd.DataFrame(rows, columns=["doc_id", "original", "encoded", "decoded", "n_symbols", "saved"])

    return j.mapInPandas(run, "doc_id long, original string, encoded string, decoded string, n_symbols long, saved long")


def with_words(t: str, names: list[tuple[int, str]]) -> str:
    """A text with whole words as §W<id>; and each § of its own doubled."""
    number = {w: i for i, w in names}
    return re.sub(r"§|[^\W_]+(?:['’-][^\W_]+)*", lambda m: "§§" if m[0] == "§" else f"§W{number[m[0]]};" if m[0] in number else m[0], t)


_SLOT = re.compile(r"§(?:§|[EWR]\d+;)")


def slots(encoded: str) -> tuple[str, list[tuple[int, str]]]:
    """A text without its symbols, and of each its place in that text."""
    out, where, n, last = [], [], 0, 0
    for m in _SLOT.finditer(encoded):
        out.append(encoded[last : m.start()])
        n += m.start() - last
        where.append((n, m[0]))
        last = m.end()
    return "".join([*out, encoded[last:]]), where


def spliced(joined: str, where: list[tuple[int, str]], clean_len: int, stride: int = 200) -> str:
    """Symbols put back into a text that may have changed a little in length since slots() took them out:
    anchors at every `stride` characters of the clean text, each moved to the nearest blank of `joined`,
    and places between two anchors in proportion. Where lengths are equal, places are exact."""
    if len(joined) == clean_len:
        def at(i: int) -> int:
            return i
    else:
        blanks = [m.start() for m in re.finditer(" ", joined)]
        marks = [0, *range(stride, clean_len, stride), clean_len]
        to = [_nearest(blanks, round(m * len(joined) / max(1, clean_len))) if 0 < m < clean_len else (m > 0) * len(joined) for m in marks]

        def at(i: int) -> int:
            k = min(i // stride, len(marks) - 2)
            a, b = marks[k], marks[k + 1]
            return round(to[k] + (i - a) / max(1, b - a) * (to[k + 1] - to[k]))

    out, last = [], 0
    for i, symbol in where:
        k = max(last, min(at(i), len(joined)))
        out += [joined[last:k], symbol]
        last = k
    return "".join([*out, joined[last:]])


def _nearest(places: list[int], x: int) -> int:
    i = bisect_left(places, x)
    return min(places[max(0, i - 1) : i + 1], key=lambda p: abs(p - x), default=x)


def slotted(docs: DataFrame) -> DataFrame:
    """(doc_id, clean, slots array<struct<at,symbol>>, ok): texts with symbols for their repeated names and
    worthwhile words, the symbols taken out; ok: whether splicing gives the encoded text back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, e in zip(b["doc_id"], b["encoded"], strict=True):
                clean, where = slots(e)
                rows.append((d, clean, [{"at": i, "symbol": x} for i, x in where], spliced(clean, where, len(clean)) == e))
            yield pd.DataFrame(rows, columns=["doc_id", "clean", "slots", "ok"])

    return encoded_symbols(docs).select("doc_id", "encoded").mapInPandas(run, "doc_id long, clean string, slots array<struct<at:int,symbol:string>>, ok boolean")
