"""One document as arrays: its marked character streams, context model, mixing weights and code lengths.

A document's words go to Arrow batches in its own row (no wider than its text), sentence by sentence. There each
distinct word of a share of documents is analysed once (functions.words), and all else runs over NumPy arrays: one
pass, no row a token or a character, no state between documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import text, words
from glossa.functions.dims import MORPH_CODES, POS_TAGS, UNKNOWN, coordinates
from glossa.operators.relations import spread
from glossa.operators.structure import huffman

RATE, FLOOR, LEAST = 1e-4, 0.05, 1e-10
CLASSES, CODES, TAGS = 7, len(MORPH_CODES), len(POS_TAGS)
NO_TAG = POS_TAGS.index("X")  # of markers
EVEN = (1 / 3, 1 / 3, 1 / 3)


@cache
def _coordinates() -> tuple[np.ndarray, np.ndarray]:
    """Class and place of each code point."""
    cls, place = np.full(0x110000, UNKNOWN[0], np.uint8), np.full(0x110000, UNKNOWN[1], np.uint8)
    for c, (k, p) in coordinates().items():
        cls[ord(c)], place[ord(c)] = k, p
    return cls, place


def coordinates_of(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Classes and places of a text's characters."""
    cls, place = _coordinates()
    at = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    return cls[at], place[at]


_MARKS = {c: coordinates()[c] for c in "^$_"}


@cache
def characters() -> np.ndarray:
    """Code point of each class and place; 0 for none."""
    out = np.zeros((CLASSES, 256), np.uint32)
    for c, (k, p) in coordinates().items():
        out[k, p] = ord(c)
    return out


class Layout:
    """Where the characters of ^root$_^root$ stand, a sentence after the other: what a decoder knows."""

    def __init__(self, sent: np.ndarray, sizes: np.ndarray, codes: np.ndarray, tags: np.ndarray):
        self.sent, self.sizes, self.codes, self.tags = sent, sizes, codes, tags
        first = np.ones(len(sizes), bool)
        first[1:] = sent[1:] != sent[:-1]
        self.first, lead = first, np.where(first, 1, 2)
        whole = sizes + lead + 1
        begin = np.cumsum(whole) - whole
        self.token = np.repeat(np.arange(len(sizes)), whole)
        at = np.arange(int(whole.sum())) - begin[self.token]
        self.inner = (at >= lead[self.token]) & (at < (lead + sizes)[self.token])
        self.code = np.where(self.inner, codes[self.token], 0)
        self.tag = np.where(self.inner, tags[self.token], NO_TAG)
        self.opens = first[self.token] & (at == 0)

    def __len__(self) -> int:
        return len(self.token)


class Marked(Layout):
    """The same with the characters' classes and places, and the class before each (0 before the first)."""

    def __init__(self, sent: np.ndarray, roots: list[str], codes: np.ndarray, tags: np.ndarray):
        cls, place = coordinates_of("".join(roots))
        self._fill(sent, np.array([len(r) for r in roots], np.int64), codes, tags, cls, place)

    @classmethod
    def of(cls, sent: np.ndarray, sizes: np.ndarray, codes: np.ndarray, tags: np.ndarray, classes: np.ndarray, places: np.ndarray) -> Marked:
        """From the roots' lengths, and the classes and places of their characters."""
        out = cls.__new__(cls)
        out._fill(sent, sizes, codes, tags, classes, places)
        return out

    def _fill(self, sent, sizes, codes, tags, classes, places) -> None:
        super().__init__(sent, sizes, codes, tags)
        whole = sizes + np.where(self.first, 2, 3)
        last = np.cumsum(whole) - 1
        begins = last - sizes - 1
        self.cls, self.place = np.empty(len(self), np.int64), np.empty(len(self), np.int64)
        for out, inner, at in ((self.cls, classes, 0), (self.place, places, 1)):
            out[self.inner] = inner
            out[last], out[begins], out[begins[~self.first] - 1] = _MARKS["$"][at], _MARKS["^"][at], _MARKS["_"][at]
        self.prev = np.append(0, self.cls[:-1]) if len(self.cls) else self.cls

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often a class follows a class inside sentences, stands under a code, and a code under a tag."""
        inside = ~self.opens
        return (
            np.bincount(self.prev[inside] * CLASSES + self.cls[inside], minlength=CLASSES**2).reshape(CLASSES, CLASSES),
            np.bincount(self.code * CLASSES + self.cls, minlength=CODES * CLASSES).reshape(CODES, CLASSES),
            np.bincount(self.tags * CODES + self.codes, minlength=TAGS * CODES).reshape(TAGS, CODES),
        )

    def deltas(self) -> np.ndarray:
        """Differences of places inside sentences; a sentence's first place as it is."""
        return self.place - np.where(self.opens, 0, np.append(0, self.place[:-1]) if len(self.place) else 0)


def places(deltas: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The inverse of deltas()."""
    total = np.cumsum(deltas)
    start = np.flatnonzero(opens)
    before = np.where(start > 0, total[start - 1], 0)
    return total - before[np.cumsum(opens) - 1]


class Model:
    """Three add-one distributions over the document's classes, from counts alone (so that both ends of a
    stream build the same one): p1 by the class before, p2 by the code, p3 by the tag through its codes."""

    def __init__(self, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray):
        self.seen = n2.sum(0) > 0
        v = max(1, int(self.seen.sum()))
        codes = (n2.sum(1) > 0) | (n3.sum(0) > 0)
        words = n3.sum(0) > 0
        self.p1 = np.where(self.seen, (n1 + 1) / (n1.sum(1, keepdims=True) + v), 0.0)
        self.p2 = np.where(self.seen & codes[:, None], (n2 + 1) / (n2.sum(1, keepdims=True) + v), 0.0)
        k = max(1, int(words.sum()))
        share = np.where(words, (n3 + 1) / (n3.sum(1, keepdims=True) + k), 0.0)
        mixed = share @ self.p2
        with np.errstate(invalid="ignore", divide="ignore"):
            self.p3 = np.where(self.seen, mixed / mixed.sum(1, keepdims=True), 0.0)
        self.n_tags = int((n3.sum(1) > 0).sum())

    def mixed(self, prev: np.ndarray, code: np.ndarray, tag: np.ndarray, share: np.ndarray, weights: tuple) -> np.ndarray:
        """Rows of probabilities of all classes; share weighs the tag's part."""
        a, b = weights[0], weights[1]
        c = weights[2] * share[:, None]
        return (a * self.p1[prev] + b * self.p2[code] + c * self.p3[tag]) / (a + b + c)


def book(tags: np.ndarray) -> dict[int, str]:
    """Huffman codes of the tags, ties by first occurrence."""
    seen, first, n = np.unique(tags, return_index=True, return_counts=True)
    order = np.argsort(first)
    return {int(k): v for k, v in huffman([(int(seen[i]), int(n[i])) for i in order]).items()} if len(tags) else {}


def shares(lay: Layout, codes: dict[int, str]) -> np.ndarray:
    """For each sentence 2 to the minus mean code length of its tags: how far structure is trusted there."""
    size = np.zeros(TAGS)
    for k, bits in codes.items():
        size[k] = len(bits)
    at = np.cumsum(lay.first) - 1
    total, n = np.bincount(at, size[lay.tags]), np.bincount(at)
    return 2.0 ** (-total / n)


def winners(m: Marked, model: Model) -> np.ndarray:
    """For each character after its sentence's first, which distribution gives it most (the first on ties)."""
    i = np.flatnonzero(~m.opens)
    return np.argmax(np.stack([model.p1[m.prev[i], m.cls[i]], model.p2[m.code[i], m.cls[i]], model.p3[m.tag[i], m.cls[i]]]), 0)


def fold(best: np.ndarray) -> tuple[float, float, float]:
    """Weights after nudging each winner up and the others down, in order. Until one reaches the floor, a step
    leaves their sum at 1, so that far they follow from how often each has won."""
    half, n = RATE / 2, len(best)
    held = 0  # steps before the floor
    if n * half < EVEN[0] - FLOOR - 1e-6:
        held = n
    else:
        low = np.full(n, np.inf)
        for k in range(3):
            np.minimum(low, np.cumsum(np.where(best == k, RATE, -half)), out=low)
        at = np.flatnonzero(low <= FLOOR - EVEN[0] + 1e-7)
        held = int(at[0]) if len(at) else n
    won = np.bincount(best[:held], minlength=3).tolist()
    x, y, z = (e + RATE * k - half * (held - k) for e, k in zip(EVEN, won, strict=True))
    for b in best[held:].tolist():
        x = x + RATE if b == 0 else x - half if x - half > FLOOR else FLOOR
        y = y + RATE if b == 1 else y - half if y - half > FLOOR else FLOOR
        z = z + RATE if b == 2 else z - half if z - half > FLOOR else FLOOR
        s = x + y + z
        x, y, z = x / s, y / s, z / s
    return x, y, z


def sentence_shares(m: Layout, model: Model, by_huffman: bool) -> np.ndarray:
    """The structure's share for each character."""
    if not len(m):
        return np.zeros(0)
    if not by_huffman:
        return np.full(len(m), 1 / max(1, model.n_tags))
    return shares(m, book(m.tags))[(np.cumsum(m.first) - 1)[m.token]]


def bits(m: Marked, model: Model, weights: tuple, by_huffman: bool) -> float:
    """Code length of the class stream."""
    if not len(m):
        return 0.0
    a, b, c = weights[0], weights[1], weights[2] * sentence_shares(m, model, by_huffman)
    p = (a * model.p1[m.prev, m.cls] + b * model.p2[m.code, m.cls] + c * model.p3[m.tag, m.cls]) / (a + b + c)
    return float(-np.log2(np.maximum(p, LEAST)).sum())


SHARE = 150_000  # words that are worked on together
_KEPT = 200_000  # distinct words whose analysis is remembered


def worded(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, bytes, ws array<array<string>>): the text's size and the words of each
    sentence; rows of one id stand side by side."""
    d = spread(docs if docs.columns == ["doc_id", "text"] else docs.select("doc_id", "text")).sortWithinPartitions("doc_id")
    return d.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), F.transform(text.sentences(text.normalised(F.col("text"))), text.words).alias("ws"))


def in_shares(batches: Iterator[pa.RecordBatch], most: int = SHARE) -> Iterator[Share]:
    """Rows of worded() in shares of at most so many words; rows of one id stay together."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        ws = batch.column(2)
        sentences = ws.offsets.to_numpy()
        per = np.diff(ws.values.offsets.to_numpy()[sentences])
        begin = 0
        for i, (d, k) in enumerate(zip(batch.column(0).to_pylist(), per.tolist(), strict=True)):
            if n + k > most and n and d != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                yield Share(held)
                held, n, begin = [], 0, i
            n, last = n + k + 1, d
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield Share(held)


class Share:
    """Some documents' tokens as arrays: row and sent (of its row) and tok (in its sentence) of each, its word as
    a number into words, roots, codes, tags (at a sentence's start, elsewhere) and sizes of the distinct words;
    group: number of each row's id among the share's ids, which stand in ids."""

    _known: dict[str, tuple[str, int, int, int]] = {}

    def __init__(self, batches: list[pa.RecordBatch]):
        id_, size, ws = (pa.concat_arrays([b.column(k) for b in batches]) for k in range(3))
        self.bytes = size.to_pylist()
        ids = id_.to_pylist()
        fresh = np.array([i == 0 or ids[i] != ids[i - 1] for i in range(len(ids))], bool)
        self.ids, self.group = id_.filter(pa.array(fresh)), np.cumsum(fresh) - 1
        self.null = [x is None for x in self.ids.to_pylist()]
        sentences = np.diff(ws.offsets.to_numpy())
        self.n_sentences = sentences
        inner = ws.flatten()
        per = np.diff(inner.offsets.to_numpy())
        coded = inner.flatten().dictionary_encode()
        self.word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.dictionary = coded.dictionary
        self.words: list[str] = self.dictionary.to_pylist()
        sent = np.repeat(np.arange(len(per)), per)
        row = np.repeat(np.arange(len(sentences)), sentences)
        self.row = row[sent]
        self.sent = (np.arange(len(per)) - (np.cumsum(sentences) - sentences)[row])[sent]
        self.tok = np.arange(len(sent)) - (np.cumsum(per) - per)[sent]
        self.n_tok = per[sent]
        info = [self._analysed(w) for w in self.words]
        self.roots = [x[0] for x in info]
        self.code = np.array([x[1] for x in info], np.int64)[self.word]
        tags = np.array([x[2:] for x in info], np.int64).reshape(-1, 2)
        self.tag = np.where(self.tok == 0, tags[self.word, 0], tags[self.word, 1])
        self._sizes = np.array([len(r) for r in self.roots], np.int64)
        self.size = self._sizes[self.word]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self._cls, self._place = coordinates_of("".join(self.roots))
        self._begin = np.cumsum(self._sizes) - self._sizes
        self._odd: dict[int, bool] = {}

    @classmethod
    def _analysed(cls, word: str) -> tuple[str, int, int, int]:
        x = cls._known.get(word)
        if x is None:
            if len(cls._known) >= _KEPT:
                cls._known.clear()
            x = cls._known[word] = (*words.analysed(word), *words.tagged(word, words.bare(word)))
        return x

    def characters(self, t) -> tuple[np.ndarray, np.ndarray]:
        """Classes and places of the roots' characters of some tokens."""
        w = self.word[t]
        size = self._sizes[w]
        end = np.cumsum(size)
        at = np.repeat(self._begin[w] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
        return self._cls[at], self._place[at]

    def surface(self, t) -> pa.Array:
        """The words of some tokens."""
        return self.dictionary.take(pa.array(self.word[t]))

    def odd(self, t) -> dict[int, str]:
        """Words that root (without characters that have no coordinates) and code don't give back, by their place
        among these tokens."""
        out = {}
        for i, w in enumerate(self.word[t].tolist()):
            known = self._odd.get(w)
            if known is None:
                root, code, *_ = self._known.get(self.words[w]) or self._analysed(self.words[w])
                known = self._odd[w] = words.applied(words.known_only(root), code) != self.words[w]
            if known:
                out[i] = self.words[w]
        return out

    def tokens_of_ids(self, nulls: bool = False) -> Iterator:
        """For each id the places of its tokens, in order; rows of one id are taken together, rows without one
        have none unless asked for."""
        group = self.group[self.row]
        end = np.cumsum(np.bincount(group, minlength=len(self.ids))).tolist() if len(self.ids) else []
        rows = np.bincount(self.group, minlength=len(self.ids)).tolist()
        begin = 0
        for g, e in enumerate(end):
            t = slice(begin, begin if self.null[g] and not nulls else e)
            if rows[g] > 1 and t.start < t.stop:
                key = [(self.sent[i], self.tok[i], self.roots[self.word[i]], self.code[i], POS_TAGS[self.tag[i]], self.words[self.word[i]], i) for i in range(t.start, t.stop)]
                t = np.array([k[-1] for k in sorted(key)], np.int64)
            yield t
            begin = e

    def marked(self, nulls: bool = False) -> Iterator[tuple[Marked, list[int], object]]:
        """Each id's streams, its rows and the places of its tokens."""
        rows = np.split(np.arange(len(self.group)), np.flatnonzero(np.diff(self.group)) + 1) if len(self.group) else []
        for t, r in zip(self.tokens_of_ids(nulls), rows, strict=True):
            yield Marked.of(self.sent[t], self.size[t], self.code[t], self.tag[t], *self.characters(t)), r.tolist(), t


HELD, BUCKET = 8_000_000, 4_000_000  # symbols that wait for others, and of one bucket


def per_document(docs: DataFrame, schema: str, prepare: Callable[[Marked, Share, object, int], tuple], finish: Callable[[list], list[tuple]] | None = None, worded_only: bool = False, nulls: bool = False) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ...): prepare(streams, share, tokens, bytes) of each row; rows of one id
    have the streams of all. With finish, what prepare gave waits for others of about the same length (within
    a factor of two), and finish makes the rows of many at once. worded_only: only ids with words, a row each; nulls: rows without an id have their words too."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = dict(docs.dtypes)["doc_id"]
    types = [_TYPES[c.split(" ", 1)[1]] for c in schema.split(", ")]

    def made(ids: list, rows: list[tuple], id_type) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, list] = {}
        sizes: dict[int, int] = {}
        id_type = None

        def flushed(k: int) -> pa.RecordBatch:
            sizes.pop(k)
            items = buckets.pop(k)
            return made([d for d, _ in items], finish([x for _, x in items]), id_type)

        for share in in_shares(batches):
            id_type = share.ids.type
            ids, rows = [], []
            for d, (m, of, t) in zip(share.ids.to_pylist(), share.marked(nulls), strict=True):
                if worded_only and not len(m):
                    continue
                for r in of[:1] if worded_only else of:
                    x = prepare(m, share, t, share.bytes[r])
                    if finish is None:
                        ids.append(d)
                        rows.append(x)
                        continue
                    k = len(m).bit_length()
                    buckets.setdefault(k, []).append((d, x))
                    sizes[k] = sizes.get(k, 0) + len(m) + 20
                    if sizes[k] >= BUCKET:
                        yield flushed(k)
                    while sum(sizes.values()) >= HELD:
                        yield flushed(max(sizes, key=sizes.__getitem__))
            if ids:
                yield made(ids, rows, id_type)
        if buckets:  # what is left goes together: fewer, wider steps
            rest = [x for k in sorted(buckets) for x in buckets[k]]
            yield made([d for d, _ in rest], finish([x for _, x in rest]), id_type)

    return worded(docs).mapInArrow(run, f"doc_id {kind}, {schema}")


_TYPES = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "map<int,string>": pa.map_(pa.int32(), pa.string())}
