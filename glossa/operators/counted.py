"""Tables of a document's tokens and characters, made a share of documents at a time as arrays: what the queries
need of contexts, tags, sentences and connectives, without a row a token crossing the network."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import words
from glossa.functions.dims import CONNECTIVES, POS_TAGS
from glossa.operators import streams
from glossa.operators.streams import CLASSES, CODES, TAGS, Share

_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def table(docs: DataFrame, schema: str, f: Callable[[Share], list], rows: bool = False, nulls: bool = True) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ...): f gives for a share the number of each row's id (of its document, with
    rows) and the columns. nulls: rows without an id stay."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in streams.in_shares(batches):
            at, *columns = f(share)
            ids = share.ids.take(pa.array(share.group[at] if rows else at))
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, _ARROW[k]) for x, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *arrays], ["doc_id", *names])

    out = streams.worded(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {', '.join(f'`{n}` {k}' for n, k in zip(names, kinds, strict=True))}")
    return out if nulls else out.where("doc_id is not null")


def marked(s: Share) -> tuple[streams.Marked, np.ndarray, np.ndarray]:
    """The streams of all rows as one, sentence after sentence; the sentence of each token and of each character."""
    line = np.cumsum(s.tok == 0) - 1
    m = streams.Marked.of(line, s.size, s.code, s.tag, *s.characters(slice(None)))
    return m, line, line[m.token]


def contexts(s: Share) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id how often a class follows a class inside sentences, stands under a code, and a code under a tag."""
    m, _, _ = marked(s)
    n = len(s.ids)
    of = s.group[s.row]
    g, inside = of[m.token], ~m.opens
    n1 = np.bincount((g[inside] * CLASSES + m.prev[inside]) * CLASSES + m.cls[inside], minlength=n * CLASSES**2)
    n2 = np.bincount((g * CODES + m.code) * CLASSES + m.cls, minlength=n * CODES * CLASSES)
    return n1.reshape(n, CLASSES, CLASSES), n2.reshape(n, CODES, CLASSES), tag_codes(s)


def tag_codes(s: Share) -> np.ndarray:
    n = len(s.ids)
    return np.bincount((s.group[s.row] * TAGS + s.tag) * CODES + s.code, minlength=n * TAGS * CODES).reshape(n, TAGS, CODES)


_NAMES = pa.array(POS_TAGS)


def _named(tags: np.ndarray) -> pa.Array:
    return _NAMES.take(pa.array(tags))


def _nonzero(n: np.ndarray) -> list[np.ndarray]:
    at = np.nonzero(n)
    return [*at, n[at]]


def char_context(docs: DataFrame) -> DataFrame:
    """(doc_id, prev, cls, n): pairs of classes inside sentences."""
    return table(docs, "prev long, cls long, n long", lambda s: _nonzero(contexts(s)[0]))


def morph_context(docs: DataFrame) -> DataFrame:
    """(doc_id, code, cls, n)."""
    return table(docs, "code long, cls long, n long", lambda s: _nonzero(contexts(s)[1]))


def struct_context(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, code, n)."""

    def rows(s: Share) -> list:
        g, tag, code, n = _nonzero(tag_codes(s))
        return [g, _named(tag), code, n]

    return table(docs, "tag string, code long, n long", rows)


def pos_frequencies(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, n)."""

    def rows(s: Share) -> list:
        g, tag, n = _nonzero(tag_codes(s).sum(2))
        return [g, _named(tag), n]

    return table(docs, "tag string, n long", rows)


def vocabularies(docs: DataFrame) -> DataFrame:
    """(doc_id, char_vocab, morph_vocab, pos_vocab): what occurs, sorted, with commas between."""

    def rows(s: Share) -> list:
        _, n2, n3 = contexts(s)
        seen = np.flatnonzero(n3.any((1, 2)))
        names = ([str(k) for k in range(CLASSES)], [str(k) for k in range(CODES)], POS_TAGS)  # tags stand in order
        return [seen, *([",".join([x for x, k in zip(xs, row, strict=True) if k]) for row in has[seen].tolist()] for xs, has in zip(names, (n2.any(1), n3.any(1), n3.any(2)), strict=True))]

    return table(docs, "char_vocab string, morph_vocab string, pos_vocab string", rows, nulls=False)


def _models(s: Share) -> Iterator[tuple[int, streams.Model, np.ndarray, np.ndarray]]:
    n1, n2, n3 = contexts(s)
    for g in np.flatnonzero(n3.any((1, 2))).tolist():
        yield g, streams.Model(n1[g], n2[g], n3[g]), n1[g], n3[g]


def smoothed(docs: DataFrame) -> DataFrame:
    """(doc_id, prev, cls, p): p1 of streams.Model for all classes that come before one."""

    def rows(s: Share) -> list:
        parts = []
        for g, m, n1, _ in _models(s):
            before = n1.sum(1) > 0
            before[0] = True  # a document's start
            prev, cls = np.nonzero(before[:, None] & m.seen)
            parts.append((np.full(len(prev), g), prev, cls, m.p1[prev, cls]))
        return _together(parts, 4)

    return table(docs, "prev long, cls long, p double", rows, nulls=False)


def by_tag(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, cls, p): p3 of streams.Model for all tags of words and for that of markers."""

    def rows(s: Share) -> list:
        parts = []
        for g, m, _, n3 in _models(s):
            has = n3.sum(1) > 0
            has[streams.NO_TAG] = True
            tag, cls = np.nonzero(has[:, None] & m.seen)
            parts.append((np.full(len(tag), g), tag, cls, m.p3[tag, cls]))
        g, tag, cls, p = _together(parts, 4)
        return [g, _named(tag), cls, p]

    return table(docs, "tag string, cls long, p double", rows, nulls=False)


def _together(parts: list[tuple], n: int) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * n


def class_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, n, total, kinds): symbols of each class, of all, and how many classes there are."""

    def rows(s: Share) -> list:
        n = contexts(s)[1].sum(1)
        g, cls, k = _nonzero(n)
        return [g, cls, k, n.sum(1)[g], (n > 0).sum(1)[g]]

    return table(docs, "cls long, n long, total long, kinds long", rows)


def unigram_bits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_symbols, bits) under the document's own add-one class frequencies."""

    def rows(s: Share) -> list:
        n = contexts(s)[1].sum(1)
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        seen = np.flatnonzero(total[:, 0])
        return [seen, total[seen, 0], (-n[seen] * np.log2((n[seen] + 1) / (total[seen] + kinds[seen]))).sum(1)]

    return table(docs, "n_symbols long, bits double", rows).withColumn("bits", F.round("bits", 4))


def first_seen(s: Share) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, tag, number) of the tags of each id, numbered from 0 by first occurrence; and each token's number."""
    key = s.group[s.row] * TAGS + s.tag
    at = s.sent << 32 | s.tok
    order = np.lexsort((at, key))
    first = order[np.diff(key[order], prepend=-1) > 0]
    first = first[np.lexsort((s.tag[first], at[first], key[first] // TAGS))]
    g = key[first] // TAGS
    number = np.arange(len(first)) - np.searchsorted(g, g)
    ids = np.zeros(len(s.ids) * TAGS, np.int64)
    ids[key[first]] = number
    return g, s.tag[first], number, ids[key]


def tag_deltas(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, tok_id, tag_id, delta): first-seen tag ids and their differences in a sentence."""

    def rows(s: Share) -> list:
        *_, number = first_seen(s)
        before = np.append(0, number[:-1]) if len(number) else number
        return [s.row, s.sent, s.tok, number, number - np.where(s.tok == 0, 0, before)]

    return table(docs, "sent_id long, tok_id long, tag_id long, delta long", rows, True, False)


def first_seen_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, id)."""

    def rows(s: Share) -> list:
        g, tag, number, _ = first_seen(s)
        return [g, _named(tag), number]

    return table(docs, "tag string, id long", rows)


_LETTER = {t: chr(97 + i) for i, t in enumerate(POS_TAGS)}
_PHRASE = re.compile(f"{_LETTER['DET']}?[{_LETTER['ADJ']}{_LETTER['NUM']}]*[{_LETTER['NOUN']}{_LETTER['PROPN']}]+".encode())


def phrases(s: Share) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token at which it begins, start, end) of maximal runs DET? (ADJ|NUM)* (NOUN|PROPN)+ of a sentence's tags."""
    line = np.cumsum(s.tok == 0) - 1
    letters = np.full(len(s.tok) + (int(line[-1]) + 1 if len(line) else 0), ord(" "), np.uint8)
    letters[np.arange(len(s.tok)) + line] = s.tag + 97
    spans = np.array([m.span() for m in _PHRASE.finditer(letters.tobytes())], np.int64).reshape(-1, 2)
    token = (np.cumsum(letters != ord(" ")) - 1)[spans[:, 0]]
    start = s.tok[token]
    return token, start, start + spans[:, 1] - spans[:, 0] - 1


def noun_phrases(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, start, end, label)."""

    def rows(s: Share) -> list:
        t, start, end = phrases(s)
        return [s.row[t], s.sent[t], start, end, ["NP"] * len(t)]

    return table(docs, "sent_id long, start long, end long, label string", rows, True)


def huffman_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, n_tags, n_bits, bitstring): each sentence's tags in its document's code."""

    def rows(s: Share) -> list:
        at, n, size, bits = [], [], [], []
        for t in s.tokens_of_ids():
            tags = s.tag[t]
            if not len(tags):
                continue
            book = streams.book(tags)
            coded = [book[k] for k in tags.tolist()]
            begin = np.flatnonzero(np.diff(s.sent[t], prepend=-1))
            first = np.arange(t.start, t.stop)[begin] if isinstance(t, slice) else t[begin]
            for a, b in zip(begin.tolist(), [*begin.tolist()[1:], len(coded)], strict=True):
                n.append(b - a)
                size.append(sum(map(len, coded[a:b])))
                bits.append("".join(coded[a:b]))
            at.append(first)
        first = np.concatenate(at) if at else np.zeros(0, np.int64)
        return [s.row[first], s.sent[first], n, size, bits]

    return table(docs, "sent_id long, n_tags long, n_bits long, bitstring string", rows, True, False)


_VOICE = re.compile(r"(^|[^A-Za-z0-9_])(is|are|was|were|be|been|being) ([A-Za-z0-9_]+ly )?[A-Za-z0-9_]+(ed|en)([^A-Za-z0-9_]|$)", re.I | re.A)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _joined(names: list[str] | pa.Array, at: np.ndarray, sizes: np.ndarray, between: str = ",") -> pa.Array:
    names = names if isinstance(names, pa.Array) else pa.array(names, pa.string())
    return pc.binary_join(_lists(names.take(pa.array(at)), sizes), between)


def _sentences(s: Share) -> tuple[np.ndarray, np.ndarray, pa.Array, list[str], list[str]]:
    """Each sentence's first token, number of tokens, words in a row, type and voice."""
    first = np.flatnonzero(s.tok == 0)
    sizes = s.n_tok[first]
    line = _joined(s.dictionary, s.word, sizes, " ")
    text = line.to_pylist()
    kind = ["INTERROGATIVE" if x.endswith("?") else "EXCLAMATORY" if x.endswith("!") else "DECLARATIVE" for x in text]
    return first, sizes, line, kind, ["PASSIVE" if _VOICE.search(x) else "ACTIVE" for x in text]


def sentence_streams(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, classes, places, codes, tags, root_lengths, type, voice, last_delta): all streams of each
    sentence's marked words, with commas between; last_delta: of the last class to the one before."""

    def rows(s: Share) -> list:
        m, _, of = marked(s)
        first, sizes, _, kind, voice = _sentences(s)
        chars = np.bincount(of, minlength=len(first))
        last = np.cumsum(chars) - 1
        numbers = [str(k) for k in range(max(256, int(s.size.max(initial=0)) + 1))]
        return [
            s.row[first], s.sent[first], _joined(numbers, m.cls, chars), _joined(numbers, m.place, chars), _joined(numbers, s.code, sizes), _joined(_NAMES, s.tag, sizes), _joined(numbers, s.size, sizes),
            kind, voice, m.cls[last] - m.cls[last - 1],
        ]

    return table(docs, "sent_id long, classes string, places string, codes string, tags string, root_lengths string, type string, voice string, last_delta long", rows, True, False)


def syntax(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, tokens, tags, sentence_type, voice, n_phrases): what is known of each sentence with words."""

    def rows(s: Share) -> list:
        first, sizes, line, kind, voice = _sentences(s)
        of = np.searchsorted(first, phrases(s)[0], "right") - 1
        return [s.row[first], s.sent[first], line, _joined(_NAMES, s.tag, sizes), kind, voice, np.bincount(of, minlength=len(first))]

    return table(docs, "sent_id long, tokens string, tags string, sentence_type string, voice string, n_phrases long", rows, True, False)


_CONNECTIVES = [(c.split(), c, r) for r, cs in CONNECTIVES.items() for c in cs]


def connectives(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, tok_id, connective, relation): rows of bare words of a sentence that are one."""

    def rows(s: Share) -> list:
        number = {w: i for i, w in enumerate(sorted({w for ws, _, _ in _CONNECTIVES for w in ws}))}
        word = np.array([number.get(words.bare(w), -1) for w in s.words], np.int64)[s.word]
        left = s.n_tok - s.tok
        known = np.flatnonzero(word >= 0)
        at, which = [], []
        for i, (ws, _, _) in enumerate(_CONNECTIVES):
            t = known[word[known] == number[ws[0]]]
            t = t[left[t] >= len(ws)]
            for k, w in enumerate(ws[1:], 1):
                t = t[word[t + k] == number[w]]
            at.append(t)
            which += [i] * len(t)
        t = np.concatenate(at)
        return [s.row[t], s.sent[t], s.tok[t], [_CONNECTIVES[i][1] for i in which], [_CONNECTIVES[i][2] for i in which]]

    return table(docs, "sent_id long, tok_id long, connective string, relation string", rows, True)


def roots(docs: DataFrame) -> DataFrame:
    """(root): all distinct roots; a share's own ones leave it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in streams.in_shares(batches):
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(s.roots)), pa.string())], ["root"])

    return streams.worded(docs).mapInArrow(run, "root string").distinct()


def returned(roots: DataFrame, unknown: str) -> DataFrame:
    """(root, back): roots as the characters of their classes and places; unknown for those that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = streams.characters()
        for b in batches:
            rs = b.column(0).to_pylist()
            points = table[streams.coordinates_of("".join(rs))]
            size = np.array([len(r) for r in rs], np.int64)
            if unknown:
                points = np.where(points > 0, points, ord(unknown)).astype(np.uint32)
            else:
                size = np.bincount(np.repeat(np.arange(len(rs)), size)[points > 0], minlength=len(rs))
                points = points[points > 0]
            line, end = points.astype("<u4").tobytes().decode("utf-32-le"), np.cumsum(size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([line[e - k : e] for k, e in zip(size.tolist(), end.tolist(), strict=True)], pa.string())], ["root", "back"])

    return roots.mapInArrow(run, "root string, back string")
