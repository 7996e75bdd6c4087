"""LM scoring by subword lattice likelihood.

A word's lattice has an arc for every vocabulary piece that fits (the existing pieces of a sentencepiece
model, with its bytes as a last resort) and one for the word as a whole, if it was learned. Arc weights
are unigram probabilities: whole words by their corpus counts, less an absolute discount that leaves the
pieces their share; pieces by ROUNDS expectation steps over all learned words (each once), which start
from the vocabulary's own ranks. The forward recursion in log space sums over
all segmentations; arcs never cross words, so a text's marginal probability is the product over its
words and its end.

There is a set of weights for each kind of text: each of the CLASSES most frequent values of `lang` among the
learned rows, and one for all other values together (one kind where there is no such column). Scoring doesn't
look at a text's kind: it sums over all kinds, weighted by their share of the learned texts.

Corpus counts are DataFrames keyed by word; documents meet them by block (some megabytes of documents
that were written together), so that a word crosses the network once a block and not once a document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.runtime import lean, ship, written

SHARE, CELLS, LONG, ROUNDS, CLASSES = 32 << 20, 100_000, 200, 2, 8
_TABLE = K.mix(np.arange(7001, 7257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_END = b"e"  # the end of a text in the word table, where words have a w in front


class Pieces:
    """The pieces of a sentencepiece model as byte strings, a blank standing for its word mark, with prior
    probabilities by their scores. Scores of a unigram model are log probabilities; those of a model of merges
    are ranks below zero, and become probabilities that fall with the rank (Zipf-Mandelbrot). Bytes that the
    model lacks, and bytes as a last resort, rank after all others. Pieces with a blank inside can't occur in
    a word and are left out."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        text: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i):
                continue
            p = sp.id_to_piece(i)
            m = re.fullmatch(r"<0x([0-9A-F]{2})>", p)
            b = bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()
            if b and (b not in text or not m) and b" " not in b[1:]:
                text[b] = -math.inf if m else sp.get_score(i)
        for i in range(256):
            text.setdefault(bytes([i]), -math.inf)
        self.text = sorted(text, key=lambda b: (-text[b], b))
        v = np.array([text[b] for b in self.text])
        known = np.isfinite(v)
        if known.any() and abs(float(np.exp(v[known]).sum()) - 1) < 0.1:  # log probabilities
            self.prior = np.where(known, v, v[known].min() - 2)
        else:
            self.prior = -np.log(np.arange(len(v)) + 10.0)
        self.prior -= np.log(np.exp(self.prior).sum())
        h = np.array([self._hash(t) for t in self.text], np.uint64)
        order = np.argsort(h)
        self.hash, self.id = h[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.longest = max(map(len, self.text))

    @staticmethod
    def _hash(t: bytes) -> int:
        h = 0
        for c in t:
            h = (h * int(_BASE) + int(_TABLE[c])) & ((1 << 64) - 1)
        return int(K.mix(np.array([h + len(t)], np.uint64))[0])

    def arcs(self, b: np.ndarray) -> list[np.ndarray]:
        """b: words of one length as columns of bytes. For each piece length from 1, the id of the piece
        that starts at each place (row), or -1."""
        out, h = [], np.zeros(b.shape, np.uint64)
        v = _TABLE[b]
        for n in range(1, min(self.longest, len(b)) + 1):
            h = h[: len(b) - n + 1] * _BASE + v[n - 1 :]
            g = K.mix(h + np.uint64(n))
            ids = np.full(g.shape, -1, np.int32)
            at = np.nonzero(self.maybe[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
            x = g[at]
            i = np.minimum(np.searchsorted(self.hash, x), len(self.hash) - 1)
            ids[at] = np.where(self.hash[i] == x, self.id[i], -1)
            out.append(ids)
        return out


def forward(arcs: list[np.ndarray], logp: np.ndarray) -> np.ndarray:
    """Log probability of each place being reached, summed over all segmentations before it: places x
    words, or places x kinds x words where logp has a row for each kind."""
    n, w = arcs[0].shape
    a = np.full((n + 1, *logp.shape[:-1], w), -np.inf)
    a[0] = 0
    for j in range(1, n + 1):
        for k in range(1, min(j, len(arcs)) + 1):
            ids = arcs[k - 1][j - k]
            live = np.flatnonzero(ids >= 0)
            if len(live) == w:
                a[j] = np.logaddexp(a[j], a[j - k] + logp[..., ids])
            elif len(live):
                a[j][..., live] = np.logaddexp(a[j][..., live], a[j - k][..., live] + logp[..., ids[live]])
    return a


def _sparse(arcs: list[np.ndarray], i: int) -> list[list[tuple[int, int]]]:
    """The arcs of one word (a column) by their ends: start and piece."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(arcs[0]) + 1)]
    for k, ids in enumerate(arcs, 1):
        col = ids[:, i]
        for a in np.flatnonzero(col >= 0).tolist():
            out[a + k].append((a, int(col[a])))
    return out


def _log_sum(v: list[float]) -> float:
    top = max(v, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in v))


def long_forward(arcs: list[np.ndarray], logp: np.ndarray, i: int) -> list[float]:
    """As forward() for one word and one kind, arc by arc: for long words, which are few of a length."""
    a = [0.0]
    for ends in _sparse(arcs, i)[1:]:
        a.append(_log_sum([a[s] + float(logp[k]) for s, k in ends]))
    return a


def long_expected(arcs: list[np.ndarray], logp: np.ndarray, i: int, out: np.ndarray) -> None:
    a, ends = long_forward(arcs, logp, i), _sparse(arcs, i)
    n = len(a) - 1
    b = [-math.inf] * n + [0.0]
    for j in range(n, 0, -1):
        for s, k in ends[j]:
            step = float(logp[k]) + b[j]
            b[s] = _log_sum([b[s], step])
            out[k] += math.exp(a[s] + step - a[n])


def expected(arcs: list[np.ndarray], logp: np.ndarray, times: np.ndarray, out: np.ndarray) -> None:
    """Add to out how often each piece is expected to be used in words that occur so many times."""
    a = forward(arcs, logp)
    n, w = arcs[0].shape
    b = np.full((n + 1, w), -np.inf)
    b[n] = 0
    total = a[n]
    for i in range(n - 1, -1, -1):
        for k in range(1, min(n - i, len(arcs)) + 1):
            ids = arcs[k - 1][i]
            live = np.flatnonzero(ids >= 0)
            if not len(live):
                continue
            ids = ids[live]
            step = logp[ids] + b[i + k][live]
            b[i][live] = np.logaddexp(b[i][live], step)
            share = np.exp(a[i][live] + step - total[live]) * times[live]
            if len(live) < 256:
                np.add.at(out, ids, share)
            else:
                out += np.bincount(ids, share, len(out))


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of `words` (indices) of one length, with a blank before each, as columns of bytes."""
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order])) + 1
    for part in np.split(order, edges):
        if not len(part):
            continue
        n = int(size[part[0]]) + 1
        step = max(1, CELLS // n)
        for k in range(0, len(part), step):
            rows = part[k : k + step]
            yield rows, np.frombuffer(b"".join(b" " + words[i] for i in rows), np.uint8).reshape(len(rows), n).T


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _words(b: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = K.lowered(b.data)
    s, e, first = K.word_bounds(data, b.offs)
    return data, s, e, first, K.span_hashes(data, s, e)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score(docs: DataFrame, path: str, whole_words: bool = True) -> DataFrame:
    """docs (doc_id, text and any others) -> (doc_id, held_out boolean, n_tokens, n_known, train_tokens
    long, base_score, score double), a row per row; path: a sentencepiece model that every executor reads.

    A-Z lower-cased; tokens: words [^\\x20\\x09-\\x0D]+, then one end. Learned from rows whose crc32(doc_id
    as text) mod 10 isn't 0 (a null id counts as an empty text: held out). Null and empty texts are their
    end only. base_score: log10 probability by add-0.1 word unigrams; score: the lattice's. With nothing
    to learn from, or without whole_words, words have the vocabulary's arcs only; base_score is that of zero
    counts where there are none. Long texts and words are
    scored whole, repeated rows count as often as they stand, columns beside doc_id, text and lang are not
    read, and an empty table gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    d = lean(docs, "doc_id", "text", *(["lang"] if "lang" in docs.columns else [])).withColumn("held_out", held_out(F.col("doc_id")))
    kind = dict(d.dtypes)["doc_id"]
    names: list = []
    kinds = 1
    if "lang" in d.columns:
        found = d.where("not held_out").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(CLASSES + 1).collect()
        names = [r.lang for r in found[:CLASSES]]
        kinds = max(1, len(found))
    cls = F.lit(len(names) if kinds > len(names) else 0)  # all other values
    for k, name in enumerate(names):
        cls = F.when(F.col("lang").eqNullSafe(F.lit(name)), k).otherwise(cls)
    d = d.select("doc_id", "text", "held_out", F.when(F.col("held_out"), -1).otherwise(cls).cast("int").alias("cls"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        block, n = TaskContext.get().partitionId() << 24, 0
        for b in K.blocks(batches):
            if n > SHARE:
                block, n = block + 1, 0
            n += len(b.data)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), block)), b.column("doc_id"), b.column("held_out"), b.column("cls"), pa.array([z.compress(b.raw(i)) for i in range(len(b))], pa.binary())], ["block", "doc_id", "held_out", "cls", "z"])

    texts = written(d.mapInArrow(deal, f"block long, doc_id {kind}, held_out boolean, cls int, z binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: dict[bytes, int] = {}  # kind + 1 as a byte, then the word -> learned count

        def out() -> pa.RecordBatch:
            keys = [k for k in held if k[0] or not any(bytes([c + 1]) + k[1:] in held for c in range(kinds))]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), now, np.int64)), pa.array([k[1:] for k in keys], pa.binary()), pa.array([k[0] - 1 for k in keys], pa.int32()), pa.array([held[k] for k in keys], pa.int64())], ["block", "word", "cls", "n"])

        for part in _blocks_of(batches):
            block = part.column("block")[0].as_py()
            if block != now:
                if held:
                    yield out()
                now, held = block, {}
            data, s, e, first, h = _words(part)
            cls = part.column("cls").to_numpy()
            of = np.repeat(cls, np.diff(first))
            distinct, at, times = np.unique(K.mix(h + (of + 2).astype(np.uint64)), return_index=True, return_counts=True)
            for x, y, c, n in zip(s[at].tolist(), e[at].tolist(), of[at].tolist(), times.tolist(), strict=True):
                w = bytes([c + 1]) + b"w" + data[x:y].tobytes()
                held[w] = held.get(w, 0) + (n if c >= 0 else 0)
            for c in np.unique(cls).tolist():
                w = bytes([c + 1]) + _END
                held[w] = held.get(w, 0) + (int((cls == c).sum()) if c >= 0 else 0)
        if held:
            yield out()

    seen = written(texts.select("block", "cls", "z").mapInArrow(count, "block long, word binary, cls int, n long"))
    cs = [f"c{k}" for k in range(kinds)]
    known = written(seen.groupBy("word").agg(*[F.sum(F.when(F.col("cls") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(cs)]))
    every = sum((F.col(c) for c in cs), F.lit(0))
    stats = [F.sum(every).alias("n"), F.sum((every > 0).cast("long")).alias("v")]
    for c in cs:
        stats += [F.sum(c), F.sum((F.col(c) > 0).cast("long")), F.sum((F.col(c) == 1).cast("long")), F.sum((F.col(c) == 2).cast("long"))]
    row = [x or 0 for x in known.agg(*stats).first()]
    total, distinct_words = row[:2]
    size, vocabulary, once, twice = (np.array(row[2 + i :: 4], np.float64) for i in range(4))
    cut = np.where((once > 0) & (twice > 0), once / np.maximum(once + 2 * twice, 1), 0.5)  # the discount
    with np.errstate(divide="ignore"):
        left = np.where(size > 0, np.log(cut * vocabulary / np.maximum(size, 1)), 0.0)  # what it leaves to the pieces
        ends = known.where(F.col("word") == F.lit(_END)).first()
        share = np.array([ends[c] for c in cs], np.float64) if ends else np.zeros(kinds)
        share = np.log10(share / share.sum()) if share.sum() else np.zeros(1)
        # without arcs for whole words the pieces have all that ends leave
        ended = np.log1p(-np.array([(ends[c] - d) / n if ends and n > ends[c] else 0.5 for c, d, n in zip(cs, cut, size, strict=True)]))[:, None]

    def weights(p: Pieces, learned: list[dict[int, float]]) -> np.ndarray:
        out = []
        for found in learned:
            n = np.exp(p.prior) * 100.0
            n[[*found]] += [*found.values()]
            out.append(np.log(n / n.sum()) if found else p.prior)
        return np.array(out)

    learned: list[dict[int, float]] = [{} for _ in range(kinds)]
    used = known.where(every > 0).where(F.col("word") != F.lit(_END))
    for _ in range(ROUNDS):

        def expect(batches: Iterator[pa.RecordBatch], learned: list[dict[int, float]] = learned) -> Iterator[pa.RecordBatch]:
            p = pieces(path)
            logp, out = weights(p, learned), np.zeros((kinds, len(p.text)))
            for batch in batches:
                words = [w[1:] for w in batch.column(0).to_pylist()]
                for k in range(kinds):
                    mine = np.flatnonzero(batch.column(k + 1).to_numpy() > 0)
                    for rows, b in by_length([words[i] for i in mine]) if len(mine) else ():
                        arcs = p.arcs(b)
                        if len(b) > LONG:
                            for i in range(len(rows)):
                                long_expected(arcs, logp[k], i, out[k])
                        else:
                            expected(arcs, logp[k], np.ones(len(rows)), out[k])
            k, at = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(out[k, at])], ["cls", "piece", "n"])

        got = used.select("word", *cs).mapInArrow(expect, "cls int, piece int, n double").groupBy("cls", "piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece and kind
        learned = [{} for _ in range(kinds)]
        for r in got:
            learned[r.cls][r.piece] = r.n

    lps = [f"lp{k}" for k in range(kinds)]

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        logp = weights(p, learned)
        for batch in batches:
            words = batch.column(0).to_pylist()
            c = np.array([batch.column(k + 1).to_numpy() for k in range(kinds)], np.float64)
            with np.errstate(divide="ignore"):
                whole = np.where(c > 0, np.log((np.maximum(c, 1) - cut[:, None]) / np.maximum(size, 1)[:, None]), -np.inf)
            ends = np.array([w == _END for w in words])
            if not whole_words:
                whole[:, ~ends] = -np.inf
            lp = np.full(c.shape, np.log(1e-3)) + left[:, None]  # stays so for an end that was never learned
            at = np.array([i for i, w in enumerate(words) if w != _END], np.int64)
            for rows, b in by_length([words[i][1:] for i in at]) if len(at) else ():
                arcs = p.arcs(b)
                if len(b) > LONG:
                    got = np.array([[long_forward(arcs, logp[k], i)[-1] for i in range(len(rows))] for k in range(kinds)])
                else:
                    got = forward(arcs, logp)[-1]
                lp[:, at[rows]] = got + (left[:, None] if whole_words else ended)
            lp = np.logaddexp(lp, whole) / np.log(10)
            raw = [w[1:] for w in words]
            n = np.array([len(w) for w in raw], np.int64)
            stop = np.cumsum(n)
            h = np.zeros(len(raw), np.uint64)  # 0: the end
            full = np.flatnonzero(n > 0)
            h[full] = K.span_hashes(np.frombuffer(b"".join(raw), np.uint8), (stop - n)[full], stop[full])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(K.signed(h)), pa.array(c.sum(0).astype(np.int64)), *(pa.array(x.astype(np.float32)) for x in lp)], ["word", "h", "c", *lps])

    scored = known.mapInArrow(lattice, "word binary, h long, c long, " + ", ".join(f"{x} float" for x in lps))
    wanted = seen.select("block", "word").join(scored, "word").select("block", "h", "c", *lps)
    base_total = np.log10(total + 0.1 * (distinct_words + 1))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        h, at = np.unique(right.column("h").to_numpy().view(np.uint64), return_index=True)
        c = right.column("c").to_numpy()[at]
        lp = [right.column(x).to_numpy()[at].astype(np.float64) for x in lps]
        log_c, is_known = np.log10(c + 0.1), (c > 0).astype(np.float64)
        end = int(np.searchsorted(h, 0))
        outs = []
        for part in _blocks_of(left.to_batches()):
            *_, first, wh = _words(part)
            i = np.searchsorted(h, wh) if len(wh) else np.zeros(0, np.int64)
            n, m = np.diff(first), len(part)
            doc = np.repeat(np.arange(m), n)
            base = np.bincount(doc, log_c[i], m) + log_c[end] - (n + 1) * base_total
            z = np.array([np.bincount(doc, x[i], m) + x[end] for x in lp]) + share[:, None]
            top = z.max(0)
            value = top + np.log10((10 ** (z - top)).sum(0))
            count = np.bincount(doc, is_known[i], m).astype(np.int64) + int(is_known[end])
            outs.append(pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(n + 1), pa.array(count), pa.array(np.full(m, total, np.int64)), pa.array(base), pa.array(value)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.Table.from_batches(outs)

    return texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(meet, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[K.Block]:
    """Blocks of one `block` number from rows with packed texts (z)."""
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        number = batch.column(batch.schema.get_field_index("block")).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            i = a
            body = batch.column(batch.schema.get_field_index("z"))
            while i < b:
                raw, n, j = [], 0, i
                while j < b and (n < K.BLOCK or not raw):
                    raw.append(z.decompress(body[j].as_py()))
                    n += len(raw[-1])
                    j += 1
                yield K.Block(batch.slice(i, j - i), np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
                i = j
