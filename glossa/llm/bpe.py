"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a share of the corpus lie side by side in one array of symbols. An inverted
index leads from each token pair (by the rank of what it makes) to its positions. Merges are replayed
in rank order over all positions at once; each touches only its neighbours, whose new pairs enter the
index. Pre-tokens are independent of each other, so the shares of the corpus that tasks hold give the
same ids as the whole would.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glossa.llm import kernels as K
from glossa.llm.lexer import Store, encode_blocks, groups
from glossa.llm.runtime import lean, ship

SHARE = 24 << 20
_NONE = 1 << 40


class Ranks:
    """A vocabulary of byte strings with ranks, which are the ids too."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.span = max(self.ranks.values()) + 1
        made = [(a * self.span + b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        pairs = np.array(sorted(made), np.int64).reshape(-1, 2)
        self.pair, self.makes = pairs[:, 0].copy(), pairs[:, 1].copy()
        # symbols that, once made, may make another of lower rank: replayed one a word at a time
        self.sinks = np.zeros(self.span, bool)
        for part in (self.pair // self.span, self.pair % self.span):
            self.sinks[part[self.makes < part]] = True
        by_id = [b""] * self.span
        for t, r in self.ranks.items():
            by_id[r] = t
        self.text = np.frombuffer(b"".join(by_id), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in by_id])])
        self.store = Store(self.encode)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a * self.span + b
        i = np.minimum(np.searchsorted(self.pair, k), len(self.pair) - 1)
        return np.where(self.pair[i] == k, self.makes[i], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        rest = np.flatnonzero(whole < 0)
        ids, counts = self.replay([words[i] for i in rest])
        count = np.ones(len(words), np.int64)
        count[rest] = counts
        out = np.empty(int(count.sum()), np.int64)
        known = np.ones(len(out), bool)
        end = np.cumsum(count)
        if len(rest):
            inner = np.repeat(end[rest] - counts - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))
            known[inner] = False
            out[inner] = ids
        out[known] = whole[whole >= 0]
        return out, count

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        size = np.array([len(w) for w in words], np.int64)
        if not n:
            return np.zeros(0, np.int64), size
        word = np.repeat(np.arange(len(words)), size)
        tok = self.single[data]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        end = np.cumsum(size)
        nxt[end[size > 0] - 1] = -1
        prv[(end - size)[size > 0]] = -1
        made = np.full(n, _NONE, np.int64)
        inner = np.flatnonzero(nxt >= 0)
        made[inner] = self.rank(tok[inner], tok[inner + 1])
        order = np.argsort(made, kind="stable")
        order = order[: np.searchsorted(made[order], _NONE)]
        ranks, at = np.unique(made[order], return_index=True)
        index: dict[int, list[np.ndarray]] = {r: [p] for r, p in zip(ranks.tolist(), np.split(order, at[1:]), strict=True)} if len(ranks) else {}
        queue = ranks.tolist()
        alive = np.ones(n, bool)
        while queue:
            r = heapq.heappop(queue)
            lists = index.pop(r, None)
            if lists is None:
                continue
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            pos = pos[made[pos] == r]
            if len(pos) > 1:
                chained = np.zeros(len(pos), bool)
                chained[1:] = nxt[pos[:-1]] == pos[1:]
                if chained.any():
                    k = np.arange(len(pos))
                    pos = pos[(k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0]
                if self.sinks[r]:
                    one = np.ones(len(pos), bool)
                    one[1:] = word[pos[1:]] != word[pos[:-1]]
                    if not one.all():
                        index[r] = [pos[~one]]
                        heapq.heappush(queue, r)
                        pos = pos[one]
            if not len(pos):
                continue
            gone = nxt[pos]
            after = nxt[gone]
            tok[pos] = r
            nxt[pos] = after
            alive[gone] = False
            made[gone] = _NONE
            linked = after >= 0
            prv[after[linked]] = pos[linked]
            before = prv[pos]
            touched = np.unique(np.concatenate([pos, before[before >= 0]]))
            follow = nxt[touched]
            new = np.where(follow >= 0, self.rank(tok[touched], tok[follow]), _NONE)
            made[touched] = new
            live = new < _NONE
            if live.any():
                touched, new = touched[live], new[live]
                order = np.lexsort((touched, new))
                touched, new = touched[order], new[order]
                first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
                for rank, p in zip(new[first].tolist(), np.split(touched, first[1:]) if len(first) > 1 else [touched], strict=True):
                    if rank in index:
                        index[rank].append(p)
                    else:
                        index[rank] = [p]
                        heapq.heappush(queue, rank)
        return tok[alive], np.bincount(word[alive], minlength=len(words))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        a = self.at[ids]
        n = self.at[ids.astype(np.int64) + 1] - a
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        return self.text[np.repeat(a - (end - n), n) + np.arange(total)]


@cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text and any others) -> (doc_id, ids array<int>), by the ranks in the file at path,
    which every executor can read. Null and empty texts give no ids; special tokens are plain text."""
    ship(docs.sparkSession)
    d = lean(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = ranks(path)
        for held in groups(K.blocks(batches), SHARE):
            for b, (ids, first) in zip(held, encode_blocks(held, v.store, True), strict=True):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.view(np.int32)))], ["doc_id", "ids"])

    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes binary). Null ids give no bytes."""
    ship(encoded.sparkSession)
    d = lean(encoded, "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = ranks(path)
        for batch in batches:
            out = [v.decode(np.array(x or [], np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text and any others) -> (doc_id, n_tokens long, ids_sha256, decoded_sha256 string), a
    row per row, encoded and decoded in one pass. Null and empty texts have no ids and the digests of
    nothing; long texts are whole; repeated rows get equal results; an empty table an empty one."""
    ship(docs.sparkSession)
    d = lean(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = ranks(path)
        for held in groups(K.blocks(batches), SHARE):
            for b, (ids, first) in zip(held, encode_blocks(held, v.store, True), strict=True):
                each = [ids[x:y] for x, y in zip(first[:-1], first[1:], strict=True)]
                out = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in ([e.astype("<u4").tobytes() for e in each], [v.decode(e).tobytes() for e in each])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first)), *map(pa.array, out)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
