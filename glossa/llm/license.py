"""License scans by diagonal voting.

All rolling word 3-gram hashes of all documents are joined with the positions of the templates' 3-grams
(a table of fixed size). A hit votes for its diagonal, the word of the document at which the template
would begin. Neighbouring diagonals merge into bands of fixed width, so that a few words too many or too
few don't split a span, and a band is verified by the share of the template's 3-gram places that it holds,
each counted once; the width keeps them in the template's order up to SLACK words. Two independent 64-bit
hashes stand for a gram's words. Base phrases must hold every 3-gram on one diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.runtime import lean, row_key, ship, written

GRAM, SLACK, VERIFIED = 3, 3, 0.6
#: The phrases that count as base, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Passages of public licences, by which the method finds more.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_SEEDS = (2001, 4001)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lowered data, and each document's first."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = _WORD[data]
    edge = np.zeros(len(data), bool)
    edge[offs[:-1][offs[:-1] < offs[1:]]] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, offs)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """document, place and two hashes of each 3-gram, and the words per document."""
    s, e, first = words(data, offs)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    i = np.flatnonzero(doc[: max(0, len(s) - GRAM + 1)] == doc[GRAM - 1 :])
    out = []
    for seed in _SEEDS:
        h = K.sequences(K.span_hashes(data, s, e, seed), GRAM)
        out.append(K.signed(h[i]) if len(i) else np.zeros(0, np.int64))
    return doc[i], i - first[doc[i]], *out, n


@cache
def template_rows() -> list[tuple]:
    """(template, place, h, h2) of every 3-gram of every template; base phrases are the first templates."""
    rows = []
    for t, (text, _) in enumerate((*BASE, *TEMPLATES)):
        data = np.frombuffer(text.encode(), np.uint8)
        _, at, h, h2, _ = grams(data, np.array([0, len(data)]))
        rows += [(t, int(a), int(x), int(y)) for a, x, y in zip(at, h, h2, strict=True)]
    return rows


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) -> (doc_id, n_words, n_base, first_word, last_word long,
    base_labels, labels string, score double), a row per row.

    Words are runs of [0-9a-z] and non-ASCII characters of the text with A-Z lowered. n_base: places of
    base phrases; first_word, last_word: their smallest and largest word, else null. Labels are distinct,
    sorted, comma-joined. score: 1 with a base place, else the best verified share of a template, else 0.
    Null and empty texts have no words and labels ''. Equal rows get equal results, long texts are scanned
    whole, columns beside doc_id and text are not read, and an empty table gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    d = lean(docs, "doc_id", "text").withColumn("rk", row_key("doc_id", "text"))
    kind = dict(d.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches):
            doc, at, h, h2, n = grams(K.lowered(b.data), b.offs)
            rk = b.column("rk").to_numpy()
            m = len(doc)
            own = pa.concat_arrays([pa.nulls(m, b.column("doc_id").type), b.column("doc_id")])
            yield pa.RecordBatch.from_arrays(
                [own, pa.array(np.concatenate([rk[doc], rk])), pa.array(np.concatenate([at, n]).astype(np.int32)), *(pa.array(np.concatenate([x, np.zeros(len(b), np.int64)])) for x in (h, h2))],
                ["doc_id", "rk", "at", "h", "h2"],
            )

    # a row (-1, ...) takes each document's word count along
    templates = spark.createDataFrame([*template_rows(), (-1, 0, 0, 0)], "template int, place int, h long, h2 long")
    met = d.select("doc_id", "rk", "text").mapInArrow(run, f"doc_id {kind}, rk long, at int, h long, h2 long").join(F.broadcast(templates), ["h", "h2"])
    met = written(met.select("doc_id", "rk", "template", "at", "place"))  # hits and a row per document
    hits = met.where("template >= 0").select("rk", "template", (F.col("at") - F.col("place")).alias("diagonal"), "place").distinct()
    votes = hits.groupBy("rk", "template", "diagonal").agg(F.count("*").alias("n"))

    # a hit votes for each band of SLACK + 1 diagonals that its own lies in; a template place counts once a band
    near = hits.select("rk", "template", F.explode(F.sequence(F.col("diagonal") - SLACK, F.col("diagonal"))).alias("diagonal"), "place")
    band = near.groupBy("rk", "template", "diagonal").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))).alias("places"))
    band = band.groupBy("rk", "template").agg(F.max(F.bit_count("places")).alias("n"))

    sizes = {t: len(text.split()) - GRAM + 1 for t, (text, _) in enumerate((*BASE, *TEMPLATES))}
    size = F.element_at(F.array(*[F.lit(sizes[t]) for t in sorted(sizes)]), F.col("template") + 1)
    label = F.element_at(F.array(*[F.lit(x) for _, x in (*BASE, *TEMPLATES)]), F.col("template") + 1)
    base = votes.where(F.col("template") < len(BASE)).where(F.col("n") == size)
    base = base.groupBy("rk").agg(F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.array_sort(F.collect_set(label)).alias("base"))
    more = band.where(F.col("template") >= len(BASE)).withColumn("share", F.col("n") / size).where(F.col("share") >= VERIFIED)
    more = more.groupBy("rk").agg(F.array_sort(F.collect_set(label)).alias("more"), F.max("share").alias("share"))

    none = F.array().cast("array<string>")
    out = met.where("template < 0").select("doc_id", "rk", F.col("at").cast("long").alias("n_words")).join(base, "rk", "left").join(more, "rk", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.coalesce("base", none), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
