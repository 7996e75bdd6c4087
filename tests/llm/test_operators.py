"""The ten operators against brute force, and their edge cases: nulls, empty and long texts, ties and
repeated rows, empty tables, clashing extra columns."""

import base64
import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import brute
import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossa.llm import bpe, embed_dedup, graph, kernels, lexer, license, lm, packing, pii, simhash, substring, syncmers, toxicity

RANKS, WORDS, PIECES = (P.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))
PASSAGE = " ".join(f"pass{i}" for i in range(50))
ODD = [None, "", " \n\t", "a", "It's  the\n\n'll  end'S 12,5 \t", "żółć ﬁ İI Σς 日本語 ½²", "word " * 30_000, "an" * 3000, *brute.thue_morse(10), *brute.thue_morse(8), "hi <|endoftext|> there", "<|startoftext|><|ENDOFTEXT|> <|endoftext|>", PASSAGE, "x " + PASSAGE + " y", "the same", "the same"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    """Real texts and odd ones; a repeated row, a null id and columns whose names clash with ours."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (1000 + ODD.index(PASSAGE), PASSAGE)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return d.withColumns({c: F.lit("own") for c in ("rk", "key", "ids", "n", "z", "block", "seg", "h", "fp", "spans", "length")})


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def same(got, want):
    """Multisets of tuples."""
    assert Counter(map(tuple, got)) == Counter(want)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, reference):
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    same(bpe.round_trip(docs, RANKS).collect(), want)
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    same([(r.doc_id, bytes(r.bytes)) for r in back.collect()], [(i, (t or "").encode()) for i, t in rows])


@given(st.lists(st.text(alphabet=st.sampled_from("anAN 'sltrevmd\n\t1²é日  -_!"), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_lexer_and_merges(reference, texts):
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    out = lexer.encode_blocks([kernels.Block(None, data, offs)], bpe.ranks(RANKS).store, True)
    ids, first = out[0]
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == reference.encode_ordinary(t)


def test_every_code_point(reference):
    """The same classes as the library's pattern: each code point after a letter, a digit and a sign."""
    text = "".join(f"a{c}1{c}!{c}\n" for c in map(chr, (*range(1, 0x3400), *range(0xA000, 0xAC00), *range(0xE000, 0x11000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F700))))
    raw = np.frombuffer(text.encode(), np.uint8)
    (ids, _), = lexer.encode_blocks([kernels.Block(None, raw, np.array([0, len(raw)]))], bpe.Ranks(RANKS).store, True)
    assert ids.tolist() == reference.encode_ordinary(text)


def brute_groups(links: np.ndarray, ids: list) -> list:
    label = np.arange(len(ids))
    while True:
        new = np.where(links, label[None, :], len(ids)).min(1)
        if (new == label).all():
            break
        label = new
    low = {}
    for k, i in zip(label.tolist(), ids, strict=True):
        if i is not None and (low.get(k) is None or i < low[k]):
            low[k] = i
    return [low.get(k, None) for k in label.tolist()]


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    rows = [(i, (base[i % 30] + rng.standard_normal(16) * (0.05 if i % 4 else 0.35)).tolist()) for i in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [1.0, None] * 8), (206, []), (207, [1.0, 2.0]), (208, [2.0, 4.0]), (None, rows[9][1]), (209, [float("inf")] * 16)]
    rows += [(300 + i, (base[0] + rng.standard_normal(16) * 0.01).tolist()) for i in range(80)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("n", F.lit(2))
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = np.eye(len(rows), dtype=bool)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and good[i] and good[j] and len(a) == len(b):
                links[i, j] = np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    group = brute_groups(links, [i for i, _ in rows])
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(d).collect()}
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i, _ in rows)
    true = int(links.sum()) - len(rows)
    assert 0.99 * true <= found <= true
    assert all(got[i].n_links <= n - 1 for (i, _), n in zip(rows, links.sum(1), strict=True))
    assert sum(got[i].component_id == g for (i, _), g in zip(rows, group, strict=True)) >= len(rows) - 1
    assert all(got[i].n_links == 0 and got[i].kept for i in (202, 203, 204, 205, 206, 209))
    assert got[207].n_links == got[208].n_links == 1 and not got[208].kept
    assert embed_dedup.near_duplicates(d.where("false")).count() == 0


def test_embedding_plan_meets_its_recall():
    for n in (10, 10_000, 10**9):
        per, tables = embed_dedup.plan(n)
        p = embed_dedup._collision(math.sqrt(2 - 1.8), embed_dedup.WIDTH) ** per
        assert 1 - (1 - p) ** tables >= 0.99 - 1e-9


def test_big_buckets_are_split(spark, monkeypatch):
    """Chunks of 8 rows give what whole buckets give."""
    from glossa.llm import buckets

    rng = np.random.default_rng(6)
    centre = rng.standard_normal(8)
    d = spark.createDataFrame([(i, (centre + rng.standard_normal(8) * 0.15).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    whole = embed_dedup.near_duplicates(d).collect()
    real = buckets.compare
    monkeypatch.setattr(embed_dedup, "compare", lambda *a, **k: real(*a, **k | {"chunk": 8}))
    same(embed_dedup.near_duplicates(d).collect(), [tuple(r) for r in whole])


def test_substrings(docs, rows):
    want = brute.windows([t for _, t in rows])
    same(substring.digest(substring.dedup_substrings(docs)).collect(), [(i, *w) for (i, _), w in zip(rows, want, strict=True)])
    assert substring.dedup_substrings(docs.where("false")).count() == 0


def test_substrings_few_words(spark):
    """Texts of a tiny vocabulary: every window's choice of gram ties."""
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["a", "b"], 90, p=[0.9, 0.1])) for _ in range(40)] + ["a " * 200, "b " * 35]
    texts += [" ".join(f"w{(i * k) % 61}" for i in range(120)) for k in (1, 2, 3, 62)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in substring.digest(substring.dedup_substrings(d)).collect()}
    assert [got[i] for i in range(len(texts))] == brute.windows(texts)


def test_factors(spark):
    """Factors cover what brute force removes; their words stand at their sources, and a factor ends only
    where its source's diagonal does."""
    rng = np.random.default_rng(11)
    pool = [[f"p{k}w{i}" for i in range(90)] for k in range(6)]
    docs = []
    for i in range(40):
        words = []
        for _ in range(4):
            k = int(rng.integers(0, 6))
            a, b = sorted(rng.integers(0, 91, 2))
            words += pool[k][a:b] + [f"own{i}x{j}" for j in range(int(rng.integers(0, 30)))]
        docs.append(words)
    docs += [docs[0], docs[3] + docs[4], ["z"] * 120]
    texts = [" ".join(d) for d in docs]
    got = spark.createDataFrame(list(enumerate(texts)), "rk long, text string")
    found = {r.rk: r.factors for r in substring.factors(got).collect()}
    longest = 0
    for i, (words, (_, gone, _)) in enumerate(zip(docs, brute.windows(texts), strict=True)):
        fs = found.get(i, [])
        assert sum(substring.covered(len(words), fs)) == gone
        for f in fs:
            assert f.length >= 35 and (f.source, f.at) != (i, f.start)
            assert words[f.start : f.start + f.length] == docs[f.source][f.at : f.at + f.length]
            longest = max(longest, f.length)
        assert all(a.start < b.start and a.start + a.length < b.start + b.length for a, b in zip(fs, fs[1:], strict=False))
    assert len(found[40]) == 1 and found[40][0].length == len(docs[0]) and longest >= len(docs[0])


def test_hashes_of_structured_words():
    for n in (3, 6, 8, 9, 10, 14):
        a, b = (x.encode() for x in brute.thue_morse(n))
        data = np.frombuffer(a + b, np.uint8)
        h = kernels.span_hashes(data, np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
        assert h[0] != h[1]
        w = kernels.sequences(np.frombuffer(a + b, np.uint8).astype(np.uint64), len(a))
        assert w[0] != w[-1]


def test_store_compares_bytes(monkeypatch, reference):
    """Ids are right also where all pre-tokens of a length have one hash."""
    monkeypatch.setattr(kernels, "span_hashes", lambda data, s, e, seed=0: (e - s).astype(np.uint64))
    texts = ["one two six tea one", "the cat sat on the mat", "x" * 700 + " " + "y" * 700]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    store = bpe.Ranks(RANKS).store
    for _ in range(2):
        (ids, first), = lexer.encode_blocks([kernels.Block(None, data, offs)], store, True)
        assert [ids[first[i] : first[i + 1]].tolist() for i in range(3)] == [reference.encode_ordinary(t) for t in texts]


def brute_fingerprint(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    x = np.array(fp, np.uint64)
    group = brute_groups(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, [i for i, _ in rows])
    same(simhash.digest(simhash.near_duplicates(docs)).collect(), [(i, f"{f:016x}", g) for (i, _), f, g in zip(rows, fp, group, strict=True)])
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_simhash_keys_meet():
    """Any two fingerprints within 3 bits share a key, wherever the bits lie."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
    a, b = (set(zip(*(v.tolist() for v in simhash.keys(f)), strict=True)) for f in (x, y))
    assert {r for r, _ in a & b} == set(range(len(x)))


def test_simhash_links_dense(spark):
    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 2**63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)} | set(rng.integers(0, 2**63, 200).tolist())
    fps = np.array(sorted(fps), np.uint64)
    signed = fps.view(np.int64).tolist()
    comp = {r.node: r.root for r in graph.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    want = brute_groups(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, signed)
    assert [comp.get(v, v) for v in signed] == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (5, 3), (3, 5), (3, 4), (1, 900)] + [(900, 1000 + i) for i in range(50)] + [(None, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 4: 3, 5: 3, 1: 1, 900: 1, **{1000 + i: 1 for i in range(50)}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_packing_holds_little(monkeypatch):
    """A worker's arrays stay small however many texts its task has, and the ids are the library's."""
    monkeypatch.setattr(packing, "lean", lambda d, *cols: d)
    docs = SimpleNamespace(dtypes=[("doc_id", "bigint")], mapInArrow=lambda run, schema: run)
    texts = [" ".join(f"w{(i * 7 + k) % 5000}" for k in range(1500)) for i in range(1600)]  # some 13 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    run = packing.pieces(docs, WORDS)
    list(run(iter([batch.slice(0, 1)])))  # the tokenizer and tables of characters are not counted
    packing._store(WORDS).clear()
    total, most = {}, 0
    tracemalloc.start()
    for b in run(iter([batch])):
        total |= zip(b.column("doc_id").to_pylist(), b.column("doc_tokens").to_pylist(), strict=True)
        most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = packing._whole(WORDS)[0]
    assert len(total) == len(texts) and all(total[i] == len(whole.encode(texts[i], add_special_tokens=False).ids) + 1 for i in (0, 700, 1599))
    assert most < 300 << 20  # 187 MB; 547 with shares of 12 MB in blocks of 4


def test_packing(docs, rows):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(WORDS)
    out = packing.pack(docs, WORDS).collect()
    got = {}
    for r in out:
        got.setdefault((r.doc_id, r.doc_tokens, r.start), []).append((r.length, r.ids_crc32))
    want = {}
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want.setdefault((i, len(ids), s), []).append((len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert sorted(seqs) == list(range(len(seqs)))
    assert packing.pack(docs.where("false"), WORDS).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300)))
@settings(max_examples=100, deadline=None)
def test_placements(histogram):
    placed, n = packing.place(histogram, 64)
    fill = Counter()
    for length in histogram:
        mine = sorted((lo, k) for x, lo, k, _, _ in placed if x == length)
        assert mine[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(mine, mine[1:], strict=False)) and sum(mine[-1]) == histogram[length]
    for length, _, k, seq, offset in sorted(placed, key=lambda x: x[4]):
        for s in range(seq, seq + k):
            assert fill[s] == offset
            fill[s] += length
    assert all(v <= 64 for v in fill.values()) and set(fill) == set(range(n))


def test_lm(docs, rows):
    tokens = {}
    count = Counter()
    for k, (i, t) in enumerate(rows):
        tokens[k] = (t or "").encode().lower().split() + [None]
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            count.update(tokens[k])
    n, v = sum(count.values()), len(count)
    out = lm.score(docs, PIECES).collect()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out)
    want = Counter((i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(tokens[k]), sum(count[w] > 0 for w in tokens[k]), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[k]), 5)) for k, (i, _) in enumerate(rows))
    assert got == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert lm.score(docs.where("false"), PIECES).count() == 0
    assert lm.score(docs.where("doc_id is null"), PIECES).first().train_tokens == 0


def test_lattice_sums_all_segmentations():
    p = lm.pieces(PIECES)
    prob = dict(zip(p.text, np.exp(p.prior), strict=True))

    def brute(w: bytes) -> float:
        return 1.0 if not w else sum(prob.get(w[:i], 0.0) * brute(w[i:]) for i in range(1, len(w) + 1))

    words = [b"the", b"ation", b"\xc3\xa9t", b"qzx"]
    for rows, b in lm.by_length(words):
        for i, x in zip(rows, lm.forward(p.arcs(b), p.prior)[-1], strict=True):
            assert math.isclose(math.exp(x), brute(b" " + words[i]), rel_tol=1e-9)
        out = np.zeros(len(p.text))
        lm.expected(p.arcs(b), p.prior, np.ones(len(rows)), out)
        assert math.isclose(sum(out[k] * len(p.text[k]) for k in np.flatnonzero(out)), b.size, rel_tol=1e-9)


def test_syncmers(docs, rows):
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in syncmers.fingerprints(docs).collect())
    out = syncmers.fingerprints(docs).collect()
    known = [(i, t or "") for i, t in rows]
    order = sorted(known, key=lambda x: -(x[0] if x[0] is not None else -(10**18)))
    want = Counter()
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        want[i, len(t), sha((t[: len(t) - half] + nxt[:half]).encode())] += 1
    assert got == want
    by_text = {}
    text = dict(known)
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert by_text[""] == ""
    assert syncmers.fingerprints(docs.where("false")).count() == 0
    one = syncmers.fingerprints(docs.where("doc_id = 1003")).first()
    assert (one.near_next, one.edited_sha256) == (1.0, sha(b"a"))


def test_syncmers_do_not_depend_on_context():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(97, 123, 4000).astype(np.uint8).tobytes() for _ in range(2))
    texts = [a, b, a[:2000] + b[:2000], b"zz" + a]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    f = syncmers.anchors(np.frombuffer(b"".join(texts), np.uint8), offs)
    assert syncmers.likeness(f[0], f[0]) == 1 and syncmers.likeness(f[0], f[1]) == 0
    assert 0.3 < syncmers.likeness(f[0], f[2]) < 0.7 and syncmers.likeness(f[0], f[3]) > 0.95


def test_syncmers_keep_all_of_a_text(spark):
    rng = np.random.default_rng(5)
    a = bytes(rng.integers(97, 123, 60_000).astype(np.uint8))
    texts = [a, a[:500] * 3, b"an" * 3000, b"", b"short", a[:30_000] + bytes(rng.integers(97, 123, 30_000).astype(np.uint8)), a[40:]]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    f = syncmers.anchors(np.frombuffer(b"".join(texts), np.uint8), offs)
    for t, (h, at) in zip(texts, f, strict=True):
        # one text alone gives every place; its own parts of 8 bytes tell which substrings are closed
        v = syncmers._TABLE[np.frombuffer(t, np.uint8)]
        small = np.array([0] * max(0, len(t) - 7), np.uint64)
        for i in range(8 if len(small) else 0):
            small = small * np.uint64(0x9E3779B97F4A7C15) + v[i : len(t) - 7 + i]
        small = (kernels.mix(small) >> np.uint64(32)).tolist()
        want = [i for i in range(len(t) - 19) if min(small[i : i + 13]) in (small[i], small[i + 12])]
        assert sorted(at.tolist()) == (want or [0] * bool(t))
        raw, got, i, place = base64.urlsafe_b64decode(syncmers.as_string((h, at))), [], 0, 0
        while i < len(raw):
            n, k = int.from_bytes(raw[i : i + 4]), 0
            i += 4
            while True:
                place += (raw[i] & 127) << k
                k, i = k + 7, i + 1
                if raw[i - 1] < 128:
                    break
            got.append((n, place))
        assert sorted(got) == list(zip(h.tolist(), at.tolist(), strict=True))
    assert len(f[0][0]) > 5000 and syncmers.as_string((np.array([7], np.uint32), np.array([1 << 25]))) == base64.urlsafe_b64encode(b"\0\0\0\x07\x80\x80\x80\x10").decode()
    assert all(syncmers.likeness(x, x) == 1 for x in f)
    assert abs(syncmers.likeness(f[0], f[5]) - 0.5) < 0.01 and syncmers.likeness(f[0], f[6]) > 0.99
    for x, y in ((f[0], f[5]), (f[1], f[0]), (f[2], f[1])):
        assert syncmers.likeness(x, y) == pytest.approx(syncmers.likeness(y, x), abs=0.01)
    out = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts[:2])], "doc_id long, text string")).collect()}
    assert out[0].fingerprint == syncmers.as_string(f[0])


def test_syncmers_look_through_texts_in_steps():
    rng = np.random.default_rng(7)
    t = bytes(rng.integers(97, 100, syncmers.STEP + 5000).astype(np.uint8))
    (h, at), (h2, at2) = (syncmers.anchors(np.frombuffer(x + t, np.uint8), np.array([0, len(x + t)]))[0] for x in (b"", bytes(2500)))
    v, small = syncmers._TABLE[np.frombuffer(t, np.uint8)], 0
    for i in range(8):
        small = small * np.uint64(0x9E3779B97F4A7C15) + v[i : len(t) - 7 + i]
    small = kernels.mix(small) >> np.uint64(32)
    low = np.lib.stride_tricks.sliding_window_view(small, 13).min(1)
    assert np.array_equal(np.sort(at), np.flatnonzero((small[:-12] == low) | (small[12:] == low)))
    assert set(zip(h.tolist(), at.tolist(), strict=True)) <= set(zip(h2.tolist(), (at2 - 2500).tolist(), strict=True))
    # a long text needs memory for its anchors and for one step, not tens of bytes for each of its own
    t = np.frombuffer(bytes(rng.integers(97, 123, 4_000_000).astype(np.uint8)), np.uint8)
    tracemalloc.start()
    syncmers.anchors(t, np.array([0, len(t)]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * len(t)


def brute_pii(t):
    b = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    b += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * k, 10)) for k in d[-2::-2])) % 10 == 0:
            b.append(("card", m.start(), m.end()))
    return b + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


@given(st.text(alphabet=st.sampled_from("aZ9.@-+ ()0125é_%\n"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_pii_base(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_pii(docs, rows, spark):
    same([(r.doc_id, r.base_sha256) for r in pii.detect(docs).collect()], [(i, sha(pii.joined(brute_pii(t or "")).encode())) for i, t in rows])
    t = "mail a.b@c.org, call +1 (017) 555-7713, card 4111 1111 1111 1111, IBAN DE89370400440532013000, token = \"0123456789abcdef0123\", social security 123-45-6789; 999.1.1.1"
    r = pii.detect(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 0, 1, 1)
    assert {x.split(":")[0] for x in r.spans.split(",")} == {"email", "card", "phone", "iban", "secret", "ssn"}
    assert "4111" not in pii.redacted(t) and "[EMAIL]" in pii.redacted(t)
    assert not pii.mod97("DE89370400440532013001") and pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_license(docs, spark):
    extra = [(5000, "Released Under the MIT-License; under the mit license"), (5001, "CC BY-NC 4.0"), (5002, "Licensed under the Apache License, Version 2.0."), (5003, "This work is licensed under the new GNU General Public License"), (5004, "by nc cc")]
    d = docs.select("doc_id", "text", "h").union(spark.createDataFrame([(*x, "own") for x in extra], "doc_id long, text string, h string"))
    got = license.scan(d).collect()
    want = []
    rows = [(r.doc_id, r.text) for r in d.collect()]
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, lab) for ph, lab in license.BASE for k in range(len(w)) if w[k : k + len(ph.split())] == ph.split()]
        starts = [k for k, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({lab for _, lab in at}))))
    same([tuple(r)[:6] for r in got], want)
    by = {r.doc_id: r for r in got}
    assert (by[5000].n_base, by[5003].labels, by[5004].labels, by[5002].score) == (2, "gpl", "", 1.0)
    assert license.scan(docs.where("false")).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    words = [f"wo{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows, labels = [], []
    for i in range(900):
        t = list(rng.choice(words, 60))
        bad = i % 7 == 0
        if bad:
            for k in rng.choice(60, 4, replace=False):
                t[k] = str(rng.choice(["clown", "stupid", "grumfa", "grumzo", "grumli"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "you clown")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(0))
    lab = spark.createDataFrame([*labels, (5000, 1), (7777, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(d, lab).collect()}
    assert len(got) == len(rows)
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert got[5000].predicted == got[5001].predicted == 0 and 0 <= got[5001].score < 0.5
    none = toxicity.learn(d, lab.where("false"))
    assert none.score("you idiot moron scum") > none.score("hello") and toxicity.classify(d.where("false"), lab).count() == 0


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 3.0, "scu*": 3.0})
    plain, aimed, negated, reported = (g.weigh(x) for x in ("some idiot", "you idiot", "you are not an idiot", 'he said "idiot"'))
    assert aimed > plain > negated and plain > reported
    assert math.isclose(math.expm1(g.weigh("scum. scum.")), 2 * math.expm1(g.weigh("scum"))) and g.weigh("obscure") == 0
    assert g.weigh("idiot you") == aimed


def by_hand(g, text):
    """A grammar's score, clause by clause, without transducers."""
    lists = {w: k for k, ws in toxicity._LISTS.items() for w in ws.split()}
    total = 0.0
    for clause in re.split(r"[.!?;:\n|]", text.lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]", clause)
        insults = threats = 0.0
        for i, w in enumerate(words):
            value = max([g.lexicon.get(w, 0.0), *(v for k, v in g.lexicon.items() if k.endswith("*") and len(w) > len(k) - 2 and w.startswith(k[:-1]))])
            before = words[:i]
            scale = 1.0
            near = [x for x in before if lists.get(x) != toxicity.QUOTE][-3:]
            if any(lists.get(x) == toxicity.NEGATION and not g.weight_of(x) for x in near):
                scale *= 0.3
            if any(lists.get(x) == toxicity.REPORT and not g.weight_of(x) for x in before):
                scale *= 0.5
            if sum(lists.get(x) == toxicity.QUOTE for x in before) % 2:
                scale *= 0.5
            if value:
                insults += scale * value
            elif lists.get(w) == toxicity.THREAT:
                threats += scale
        if any(lists.get(x) == toxicity.TARGET and not g.weight_of(x) for x in words):
            total += 1.25 * (insults + threats * g.threat)
        elif insults:
            total += insults + 0.3 * threats
    return 1 / (1 + math.exp(-(g.bias + g.slope * math.log1p(total))))


@given(st.lists(st.sampled_from('idiot scum scumbag the you your not never said kill hurt this moron . ! | " “ nothing wasn\'t their'.split()), max_size=25))
@settings(max_examples=300, deadline=None)
def test_composed_machine_is_its_parts(words):
    g = toxicity.Grammar({"idiot": 3.0, "scu*": 2.5, "moron": 1.0})
    text = " ".join(words)
    assert math.isclose(g.score(text), by_hand(g, text), rel_tol=1e-9)


def test_threats_count_by_themselves(spark):
    g = toxicity.Grammar({"idiot": 3.0})
    plain = g.score("i will kill you")
    assert plain == g.score("you, i will kill") >= 0.5 > g.score("hello")
    for mild in ("i will not kill you", "never kill you", "he said i will kill you", '"i will kill you"'):
        assert g.score("hello") < g.score(mild) < 0.5
    assert g.score("kill the process") == g.score("overkill for you") == g.score("kill it. you") == g.score("hello")
    assert g.weigh("kill the idiot") == g.weigh("idiot kill") > g.weigh("idiot")

    rows = [(i, f"i will see you {i}" + (" fool dolt oaf" if i % 5 == 0 else "")) for i in range(200)]
    rows += [(1000 + i, f"i will kill you {i}") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for toxic in (None, 1, 0):
        lab = [(i, int(i % 5 == 0)) for i in range(200)] + [(1000 + i, toxic) for i in range(20)]
        g = toxicity.learn(d, spark.createDataFrame(lab, "doc_id long, toxic int"))
        assert (g.score("i will hurt you") >= 0.5) == (toxic != 0)
        assert g.score("i will not hurt you") < 0.5 and g.score("a fool") >= 0.5


def test_long_secrets_go_whole():
    for n in (16, 256, 257, 1000):
        out = pii.redacted("auth token = " + "aB3-" * (n // 4) + "c" * (n % 4) + " end")
        assert "aB3" not in out and "[SECRET]" in out and out.endswith(" end")
    assert "[SECRET]" not in pii.redacted("auth token = " + "a" * 15)
