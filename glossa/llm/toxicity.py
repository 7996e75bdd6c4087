"""Toxicity by a weighted finite-state pattern grammar.

Tokens of a clause are read as symbols: insult, threat, target, negation, report, quote mark, other. Six
small transducers over these symbols are composed into one: insult and threat put out their word's weight,
each on its own tape; negation, reported speech and quotation scale down what follows them; target marks
the clause, wherever in it somebody is named. What a clause weighs is read off at its end, by the state
reached: insults count for more with a target, threats count with one, and only beside an insult without.
A document's score is a logistic function of the logarithm of its clauses' summed weight.

The insult lexicon (words and word beginnings) and the logistic function are learned from at most SAMPLE
labelled rows: those with the smallest hash of doc_id among the rows for learning. The lexicon is a
greedy cover of their toxic texts that shuns the others. The weight of an aimed threat follows from how
many of the labelled texts with one and without an insult are toxic (see _threat).
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.runtime import lean, ship, written

SAMPLE, COVER, LEAST, LIFT, HEADS = 4000, 6, 3, 2, range(3, 8)
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = SYMBOLS = range(7)
#: Word lists of the grammar.
_LISTS = {
    THREAT: "kill hurt destroy beat punch stab shoot smash murder attack",
    TARGET: "you your yours he she they him her them his their this these those u ur",
    NEGATION: "not no never nobody isn't aren't wasn't weren't don't doesn't didn't ain't without nicht kein pas non nunca",
    REPORT: "said says say told tells wrote writes quoted quote reported claimed called reads",
    QUOTE: "\" “ ” « »",
}
_SYMBOL = {w: k for k, words in _LISTS.items() for w in words.split()}
_SEED = ("idiot", "moron", "scum", "worthless")  # where nothing can be learned
_NEGATED, _REPORTED, _QUOTED, _AIMED, _AT_NOBODY = 0.3, 0.5, 0.5, 1.25, 0.3
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n|\"“”«»]")
_STOPS = frozenset(".!?;:\n|")


@dataclass(frozen=True)
class Transducer:
    """States from 0, where a clause starts. move(state, symbol): the next state; weight(state, symbol): what a
    symbol is worth there, a factor for each of the two tapes (insults, threats)."""

    states: int
    move: Callable[[int, int], int]
    weight: Callable[[int, int], tuple[float, float]]


def _scale(factor: float) -> Callable[[int, int], tuple[float, float]]:
    return lambda state, _: (factor, factor) if state else (1.0, 1.0)


_PARTS = {
    "insult": Transducer(1, lambda s, k: 0, lambda s, k: (float(k == INSULT), 1.0)),
    "threat": Transducer(1, lambda s, k: 0, lambda s, k: (1.0, float(k == THREAT))),
    "target": Transducer(2, lambda s, k: 1 if k == TARGET else s, lambda s, k: (1.0, 1.0)),
    "negation": Transducer(4, lambda s, k: 3 if k == NEGATION else max(0, s - (k != QUOTE)), _scale(_NEGATED)),
    "report": Transducer(2, lambda s, k: 1 if k == REPORT else s, _scale(_REPORTED)),
    "quotation": Transducer(2, lambda s, k: 1 - s if k == QUOTE else s, _scale(_QUOTED)),
}


def compose(parts: list[Transducer]) -> tuple[list[tuple], list[list[int]], list[list[tuple[float, float]]]]:
    """The product: its states (one of each part), next[state][symbol], and weight[state][symbol]."""
    states = list(itertools.product(*(range(t.states) for t in parts)))
    number = {s: i for i, s in enumerate(states)}
    move = [[number[tuple(t.move(x, k) for t, x in zip(parts, s, strict=True))] for k in SYMBOLS] for s in states]
    each = [[[t.weight(x, k) for t, x in zip(parts, s, strict=True)] for k in SYMBOLS] for s in states]
    return states, move, [[(math.prod(w[0] for w in ws), math.prod(w[1] for w in ws)) for ws in row] for row in each]


_STATES, _NEXT, _WEIGHT = compose(list(_PARTS.values()))
_TARGETED = [s[[*_PARTS].index("target")] == 1 for s in _STATES]


@cache
def _finder(heads: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for h in heads:
        a.add_word(h, h)
    a.make_automaton()
    return a


@dataclass
class Grammar:
    """lexicon: words, or beginnings ending in *, with their weights; threat: the weight of a threat at
    somebody; the score is 1 / (1 + exp(-(bias + slope * log(1 + weight))))."""

    lexicon: dict[str, float]
    bias: float = -3.0
    slope: float = 2.0
    threat: float = 4.0

    def __post_init__(self) -> None:
        self.lengths = sorted({len(w) - 1 for w in self.lexicon if w.endswith("*")})
        self.heads = tuple(sorted({w.rstrip("*") for w in self.lexicon} | set(_LISTS[THREAT].split())))

    def weight_of(self, word: str) -> float:
        best = self.lexicon.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            best = max(best, self.lexicon.get(word[:n] + "*", 0.0))
        return best

    def parts(self, text: str) -> Iterator[tuple[float, float, bool]]:
        """Of each clause that has any: what stands on the tapes of insults and of threats, and whether somebody
        is its target."""
        low = text.lower()
        if next(_finder(self.heads).iter(low), None) is None:
            return
        state, insults, threats = 0, 0.0, 0.0
        for w in itertools.chain(_TOKEN.findall(low), "."):
            if w in _STOPS:
                if insults or threats:
                    yield insults, threats, _TARGETED[state]
                state, insults, threats = 0, 0.0, 0.0
                continue
            value = self.weight_of(w)
            symbol = INSULT if value else _SYMBOL.get(w, OTHER)
            a, b = _WEIGHT[state][symbol]
            insults, threats = insults + a * value, threats + b
            state = _NEXT[state][symbol]

    def clauses(self, text: str) -> Iterator[float]:
        """Weight of each clause that has any."""
        for insults, threats, aimed in self.parts(text):
            if aimed:
                yield _AIMED * (insults + threats * self.threat)
            elif insults:
                yield insults + threats * _AT_NOBODY

    def threatens(self, text: str) -> bool:
        """Whether a plain threat at somebody stands in a text without insults."""
        parts = [*self.parts(text)]
        return not any(w for w, _, _ in parts) and any(aimed and threats >= 1 for _, threats, aimed in parts)

    def weigh(self, text: str) -> float:
        return math.log1p(sum(self.clauses(text)))

    def score(self, text: str) -> float:
        x = self.bias + self.slope * self.weigh(text)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def features(text: str) -> set[str]:
    """Distinct words, and their beginnings of HEADS letters with a *."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in HEADS if len(w) > n}


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """bias and slope of a logistic regression on one number, by damped Newton steps, with a weak prior."""
    a, b = -1.0, 1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        g = np.array([(p - y).sum() + 0.05 * (a + 1), ((p - y) * x).sum() + 0.05 * (b - 1)])
        w = p * (1 - p)
        h = np.array([[w.sum() + 0.05, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.05]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return float(a), float(max(b, 0.05))


def _threat(g: Grammar, toxic: int, total: int) -> float:
    """The weight that brings one plain threat at somebody to the rate of toxic texts among the labelled ones
    that hold one and no insult, counting two toxic texts and another beside them; not below 0."""
    rate = math.log((toxic + 2) / (total - toxic + 1))
    return max(0.0, math.expm1(min(50.0, (rate - g.bias) / g.slope)) / _AIMED)


def learn(docs: DataFrame, labels: DataFrame, learning=None, sample: int = SAMPLE) -> Grammar:
    """docs (doc_id, text), labels (doc_id, toxic); learning: which doc_id may be learned from (a
    function of the column). Rows with null doc_id, text or label are not used; equal texts count once, as
    toxic if one of them is. What reaches the driver is bounded by the texts of `sample` rows."""
    ship(docs.sparkSession)
    lab = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    if learning is not None:
        lab = lab.where(learning(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = lean(docs, "doc_id", "text").where("text is not null").join(F.broadcast(lab), "doc_id")
    rows = rows.groupBy(F.xxhash64("text").alias("k")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches, size=1 << 20):
            toxic = b.column("toxic").to_pylist()
            each = [sorted(features(b.raw(i).decode())) for i in range(len(b))]
            flat = [*itertools.chain.from_iterable(each)]
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.string()), pa.array(np.repeat(np.array(toxic, np.int32), [len(e) for e in each]))], ["f", "toxic"])

    rows = written(rows.select("text", "toxic"))
    n = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    total, toxic = n.n or 0, n.t or 0
    if not toxic or toxic == total:
        return Grammar({w: 2.0 for w in _SEED})
    counts = rows.mapInArrow(spread, "f string, toxic int").groupBy("f").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    lift = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (total - toxic + 1))
    top = counts.withColumn("lift", lift).where((F.col("t") >= LEAST) & (F.col("lift") >= LIFT)).orderBy(F.desc("t"), F.desc("lift"), "f").collect()
    number = {r.f: i for i, r in enumerate(top)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches, size=1 << 20):
            out = [sorted(number[f] for f in features(b.raw(i).decode()) if f in number) for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(out, pa.list_(pa.int32()))], ["toxic", "fs"])

    seen = rows.mapInArrow(found, "toxic int, fs array<int>").collect()  # at most `sample` rows
    chosen = cover([(r.toxic, r.fs) for r in seen], len(top))
    g = Grammar({top[i].f: float(top[i].lift) for i in chosen} or {w: 2.0 for w in _SEED}, threat=0.0)  # until it is known

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches, size=1 << 20):
            texts = [b.raw(i).decode() for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([g.weigh(t) for t in texts], pa.float64()), pa.array([g.threatens(t) for t in texts], pa.bool_())], ["toxic", "z", "threat"])

    known = rows.mapInArrow(weigh, "toxic int, z double, threat boolean").collect()
    plain = [r for r in known if not r.threat]
    g.bias, g.slope = _fit(np.array([r.z for r in plain]), np.array([r.toxic for r in plain], np.float64))
    g.threat = _threat(g, sum(r.toxic for r in known if r.threat), len(known) - len(plain))
    return g


def cover(rows: list[tuple[int, list[int]]], n: int) -> list[int]:
    """Features, best first, until each toxic row holds COVER of them or no feature helps LEAST more rows
    than it harms."""
    holders: list[list[int]] = [[] for _ in range(n)]
    clean = np.zeros(n)
    for i, (toxic, fs) in enumerate(rows):
        for f in fs:
            if toxic:
                holders[f].append(i)
            else:
                clean[f] += 1
    arrays = [np.array(h, np.int64) for h in holders]
    held = np.zeros(len(rows), np.int64)
    # helping a row that holds k already counts for 2^-k
    gain = np.array([float(len(a)) for a in arrays]) - clean
    out: list[int] = []
    while n:
        f = int(np.argmax(gain))
        if gain[f] < LEAST / 2:
            break
        true = float((np.where(held[arrays[f]] < COVER, 0.5 ** held[arrays[f]], 0.0)).sum()) - clean[f]
        if true < gain[f] - 1e-9:  # gains only shrink: look again with the true one
            gain[f] = true
            continue
        out.append(f)
        held[arrays[f]] += 1
        gain[f] = -np.inf
    return out


def held_out(doc_id):
    """Rows never learned from by the query."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) -> (doc_id, held_out boolean, score double, predicted int), a row
    per row. Only the text goes into the score; it is learned from labelled rows that are not held out
    (crc32 of the id as text mod 5 is not 0; a null id counts as an empty text). Null and empty texts
    get the score of a text without matches, long texts are read whole, repeated rows get equal scores, and an
    empty table gives an empty result. Without labels a few words known beforehand are the lexicon."""
    g = learn(docs, labels, lambda c: ~held_out(c))
    d = lean(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.blocks(batches):
            s = [g.score(b.raw(i).decode()) for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
