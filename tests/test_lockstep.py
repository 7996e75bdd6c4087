"""Coding many streams side by side gives what coding them one at a time does."""

import numpy as np
import pytest

from glossa.operators import codec, lockstep, streams
from glossa.operators.structure import huffman


def drawn(seed, longest, kinds, most):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    sizes = rng.integers(0, longest, n)
    counts = rng.integers(1, most, (n, kinds)) * (rng.random((n, kinds)) < 0.6) + (np.arange(kinds) == 0)
    if seed % 3 == 0:
        counts[:, 0] = 10_000_000  # hardly a bit a symbol
    symbols = [rng.choice(kinds, k, p=c / c.sum() if seed % 2 else (c > 0) / (c > 0).sum()) for k, c in zip(sizes, counts)]
    return sizes, counts, symbols


@pytest.mark.parametrize("seed", range(18))
def test_same_bits(seed):
    longest, kinds, most = [(5, 7, 10), (900, 2, 10_000), (2000, 140, 3)][seed % 3 if seed < 9 else (seed + 1) % 3]
    sizes, counts, symbols = drawn(seed, longest, kinds, most)
    cum = np.concatenate([np.zeros((len(sizes), 1), np.int64), np.cumsum(counts, 1)], 1)
    of, line = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(symbols)
    data = lockstep.encode(sizes, cum[of, line], cum[of, line + 1], cum[of, -1])
    for d, s, c in zip(data, symbols, cum.tolist(), strict=True):
        assert d == codec.encode_ranges((c[x], c[x + 1], c[-1]) for x in s.tolist())
    assert (lockstep.decode(data, sizes, cum, of, False) == line).all()


@pytest.mark.parametrize("seed", range(6))
def test_rans_of_many(seed):
    sizes, counts, symbols = drawn(seed, 3000, 7, 1000)
    table = np.zeros_like(counts)
    for row, c in zip(table, counts, strict=True):
        for k, v in codec.quantised({k: v / c.sum() for k, v in enumerate(c.tolist()) if v}).items():
            row[k] = v
    data = lockstep.rans_encode(sizes, np.concatenate(symbols), table)
    assert (lockstep.rans_decode(data, sizes, table) == np.concatenate(symbols)).all()
    for d, s, c, q in zip(data, symbols, counts, table, strict=True):
        one = codec.rans_encode(s.tolist(), {k: v / c.sum() for k, v in enumerate(c.tolist()) if v})
        assert abs(len(d) - len(one)) <= 1


def test_fold_follows_each_step():
    rng = np.random.default_rng(2)
    for n, p in ((0, None), (50, None), (9000, (0.98, 0.01, 0.01)), (30_000, (0.4, 0.5, 0.1)), (20_000, (0.34, 0.33, 0.33))):
        best = rng.choice(3, n, p=p)
        w = [1 / 3] * 3
        for b in best.tolist():
            w = [v + streams.RATE if i == b else max(v - streams.RATE / 2, streams.FLOOR) for i, v in enumerate(w)]
            w = [v / sum(w) for v in w]
        assert np.allclose(streams.fold(best), w, atol=1e-10, rtol=0)


def test_ids_that_repeat(spark):
    """Rows of one id have one stream, its tokens in the order of sentence and place; rows without an id have none."""
    d = spark.createDataFrame([(1, "Dogs run. Cats sit."), (1, "Birds fly high."), (None, "Nobody."), (2, None), (3, "A. B. C.")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.n_words, r.original_bytes) for r in codec.compressed(d).collect() if r.doc_id is not None)
    assert rows == [(1, 7, 15), (1, 7, 19), (2, 0, 0), (3, 3, 8)]
    back = {r.doc_id: r.words for r in codec.decompressed(codec.compressed(d.where("doc_id = 1 and text like 'D%' or doc_id = 3"))).collect()}
    assert back == {1: ["Dogs", "run.", "Cats", "sit."], 3: ["A.", "B.", "C."]}
    assert sorted((r.doc_id, r.ok) for r in codec.counts_round_trip(d).collect()) == [(1, True), (3, True)]
    assert huffman([(1, 1)]) == {1: "0"}
