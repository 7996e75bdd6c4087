"""Sequence packing: shortest-pack-first over the length histogram.

Documents become pieces of at most `size` tokens. The histogram of piece lengths (at most `size` rows,
whatever the corpus) goes to the driver, which places lengths longest first, each into the packs with
most room, and updates how many packs have each pattern. Packs of one pattern are an interval of
sequence ids, so a placement says where the pieces of one length with ranks lo..hi go; pieces are ranked
in salted groups, and each finds its placement by length and rank.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.lexer import Store, encode_blocks, groups
from glossa.llm.runtime import lean, ship, written

SIZE, END, RANKED = 2048, 1, 100_000
BLOCK, SHARE = 1 << 20, 4 << 20  # bytes of text to a block and a share: they set a worker's memory, not the ids
#: What the lexer and normalised() imitate.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])


@cache
def _whole(path: str):
    """The tokenizer as the library reads it, and the expression of its added tokens, which it looks for in
    a text as it stands. Raises ValueError for a file whose steps are not those imitated here."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal, split = ([x["type"] for x in spec[k][k + "s" if k == "normalizer" else "pretokenizers"]] for k in ("normalizer", "pre_tokenizer"))
    added = spec["added_tokens"]
    if (normal, split) != _STEPS or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": _SPLIT} or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: not a tokenizer of the kind that is imitated")
    return Tokenizer.from_file(path), re.compile(b"|".join(re.escape(t["content"].encode()) for t in added) or b"(?!)")


@cache
def _store(path: str) -> Store:
    _whole(path)
    from tokenizers import Tokenizer, pre_tokenizers
    from tokenizers.normalizers import Sequence

    t = Tokenizer.from_file(path)
    t.normalizer = Sequence([])
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    t.encode_special_tokens = True  # a pre-token holds none: texts with added tokens go to the library as they are

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        counts = []
        for k in range(0, len(words), 20_000):
            for x in t.encode_batch_fast([w.decode() for w in words[k : k + 20_000]], add_special_tokens=False):
                ids += x.ids
                counts.append(len(x.ids))
        return np.array(ids, np.int64), np.array(counts, np.int64)

    return Store(encode)


def normalised(text: str) -> str:
    """NFC and lower case, a character at a time (so a final sigma stays plain)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


def _ids(held: list[K.Block], path: str) -> Iterator[tuple[K.Block, np.ndarray, np.ndarray]]:
    """Each block with its documents' ids and where each document's begin. Documents that hold an added
    token are encoded by the library, all others by the store."""
    t, added = _whole(path)
    special = [{i for i in range(len(b)) if added.search(b.raw(i))} if added.search(b.data.tobytes()) else set() for b in held]
    normal = []
    for b, odd in zip(held, special, strict=True):
        raw = [b"" if i in odd else normalised(b.raw(i).decode()).encode() for i in range(len(b))]
        normal.append(K.Block(b.batch, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)))
    for b, odd, (ids, first) in zip(held, special, encode_blocks(normal, _store(path), False), strict=True):
        if odd:
            own = {i: np.array(t.encode(b.raw(i).decode(), add_special_tokens=False).ids, np.uint32) for i in sorted(odd)}
            parts = [own.get(i, ids[first[i] : first[i + 1]]) for i in range(len(b))]
            ids, first = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        yield b, ids, first


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, start, length, ids_crc32, doc_tokens, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(K.blocks(batches, size=BLOCK), SHARE):
            for b, ids, first in _ids(held, path):
                total = np.diff(first) + 1
                out = np.full(len(ids) + len(b), end, np.int32)
                at = np.ones(len(out), bool)
                at[np.cumsum(total) - 1] = False
                out[at] = ids
                n = -(-total // size)
                doc = np.repeat(np.arange(len(b)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(size, total[doc] - start)
                begin = (np.cumsum(total) - total)[doc] + start
                crc = [zlib.crc32(out[x : x + y].astype("<u4").tobytes()) for x, y in zip(begin, length, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), *(pa.array(np.asarray(v, np.int64)) for v in (start, length, crc, total[doc])), pa.ListArray.from_arrays(pa.array(np.append(np.cumsum(length) - length, len(out)).astype(np.int32)), pa.array(out))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    d = lean(docs, "doc_id", "text")
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>")


def place(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """length -> count  to  placements (length, lowest rank, how many, first sequence, offset) and the
    number of sequences."""
    room: dict[int, list[list[int]]] = {}  # room left -> intervals of sequences [first, count]
    out, fresh = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            most = max(room, default=0)
            if most < length:
                seq, n, most = fresh, left, size
                fresh += left
            else:
                seq, have = room[most].pop()
                n = min(have, left)
                if n < have:
                    room[most].append([seq + n, have - n])
                if not room[most]:
                    del room[most]
            out.append((length, rank, n, seq, size - most))
            rank, left = rank + n, left - n
            if most - length:
                room.setdefault(most - length, []).append([seq, n])
    return out, fresh


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """docs (doc_id, text and any others) -> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset: long), a row per piece.

    Every document's ids (by the tokenizer file at path, as its library gives them, without special tokens
    of its own), then id `end`, lie in pieces of at most size; a sequence holds at most size ids and no gap.
    Null and empty texts are one piece of one id. Equal rows make equal pieces, each placed; ties in the
    ranking are pieces equal in doc_id, start and ids. Long texts are cut at every size ids. Empty tables
    give empty results."""
    spark = docs.sparkSession
    ship(spark)
    p = written(pieces(docs, path, size, end).drop("ids"))
    histogram = {r.length: r.n for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    placements, _ = place(histogram, size)
    # salts by the number of rows, so that a group to be ranked has some RANKED rows at any size
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(1 + sum(histogram.values()) // RANKED)).cast("int")
    p = p.withColumn("salt", salt)
    cells = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = p.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(cells, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("base"))
    first = {}  # length -> lowest ranks, ascending, with the first sequence and the offset of each: a few thousand entries
    for length, lo, _, seq, offset in placements:
        first.setdefault(length, []).append((lo, seq, offset))
    table = {n: np.array(sorted(x), np.int64).T for n, x in first.items()}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                lo, start, at = table[int(n)]
                i = np.searchsorted(lo, rank[rows], "right") - 1
                seq[rows], offset[rows] = start[i] + rank[rows] - lo[i], at[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = dict(p.dtypes)["doc_id"]
    return ranked.select(*names, "rank").mapInArrow(put, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
