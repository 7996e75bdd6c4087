"""Document streams, archives and their parts against plain versions and round trips."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossa import cli
from glossa.functions import dims
from glossa.operators import codec, discourse, model, relations, report, streams, structure
from glossa.sources import readers

TEXTS = ["The quick dogs ran home. They were running, quickly!", "It costs $5 or 7€. Ünder §E0; the _tree_ ^ she unfolds 日本語. Is it?", "", None, "a", "Word " * 400, "Ann Lee met Bo. Then Ann Lee left, and Ann Lee wrote. So Bo left."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)


def plain(toks, trained, by_huffman):
    """Bits of the class stream of one document's (sent, root, code, tag), by dictionaries and loops."""
    table = dims.coordinates()
    chars = []  # class, code, tag, sentence, opens
    for s in sorted({t[0] for t in toks}):
        mine = [t for t in toks if t[0] == s]
        for k, (_, root, code, tag) in enumerate(mine):
            for ch, c, g in [("_", 0, "X")] * (k > 0) + [("^", 0, "X")] + [(x, code, tag) for x in root] + [("$", 0, "X")]:
                chars.append((table.get(ch, dims.UNKNOWN)[0], c, g, s))
    opens = [i == 0 or chars[i][3] != chars[i - 1][3] for i in range(len(chars))]
    prev = [0] + [c[0] for c in chars[:-1]]
    syms = sorted({c[0] for c in chars})
    codes = sorted({t[2] for t in toks})

    def smooth(pairs, context, symbols):
        n = [pairs.count((context, x)) for x in symbols]
        return {x: (k + 1) / (sum(n) + len(symbols)) for x, k in zip(symbols, n, strict=True)}

    n1 = [(prev[i], c[0]) for i, c in enumerate(chars) if not opens[i]]
    n2 = [(c[1], c[0]) for c in chars]
    n3 = [(t[3], t[2]) for t in toks]
    p1 = {p: smooth(n1, p, syms) for p in set(prev)}
    p2 = {c: smooth(n2, c, syms) for c in {c[1] for c in chars} | set(codes)}
    p3 = {}
    for g in {c[2] for c in chars}:
        share = smooth(n3, g, codes)
        mix = {x: sum(share[c] * p2[c][x] for c in codes) for x in syms}
        p3[g] = {x: v / sum(mix.values()) for x, v in mix.items()}
    w = [1 / 3] * 3
    if trained:
        for i, (x, c, g, _) in enumerate(chars):
            if not opens[i]:
                got = [p1[prev[i]][x], p2[c][x], p3[g][x]]
                best = got.index(max(got))
                w = [v + 1e-4 if k == best else max(v - 5e-5, 0.05) for k, v in enumerate(w)]
                w = [v / sum(w) for v in w]
    tags = [t[3] for t in toks]
    book = structure.huffman([(g, tags.count(g)) for g in dict.fromkeys(tags)])
    share = {s: 2 ** -(sum(len(book[t[3]]) for t in toks if t[0] == s) / sum(t[0] == s for t in toks)) if by_huffman else 1 / len(set(tags)) for s in {t[0] for t in toks}}
    bits = 0.0
    for i, (x, c, g, s) in enumerate(chars):
        a, b, d = w[0], w[1], w[2] * share[s]
        bits -= math.log2(max((a * p1[prev[i]][x] + b * p2[c][x] + d * p3[g][x]) / (a + b + d), 1e-10))
    return len(chars), bits, w


@pytest.mark.parametrize(("trained", "by_huffman"), [(True, True), (False, False), (True, False)])
def test_bits(spark, docs, trained, by_huffman):
    toks = {}
    for r in relations.tokens(docs).orderBy("doc_id", "sent_id", "tok_id").collect():
        toks.setdefault(r.doc_id, []).append((r.sent_id, r.root, r.code, r.tag))
    got = {r.doc_id: r for r in model.document_bits(docs, trained, by_huffman).collect()}
    assert len(got) == len(TEXTS) and got[2].bpb is None and got[3].n_symbols == 0
    for d, t in toks.items():
        n, bits, w = plain(t, trained, by_huffman)
        assert got[d].n_symbols == n and abs(got[d].bits - bits) < 1e-3
        assert max(abs(x - y) for x, y in zip((got[d].w_char, got[d].w_morph, got[d].w_struct), w, strict=True)) < 1e-9


def test_archives(spark, sf, docs, tmp_path):
    """Archives give all words back, through files of both forms too, and no text is read for that."""
    real = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    every = docs.union(real)
    c = codec.compressed(every)
    rows = c.collect()
    assert len(rows) == every.count() and all(r.error is None and r.archive for r in rows)
    assert all(r.ratio is None for r in rows if not r.original_bytes) and all(r.archive_bytes == len(r.archive) for r in rows)
    want = {r.doc_id: [x.word for x in r.r] for r in relations.tokens(every).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_id", "tok_id", "word"))).alias("r")).collect()}
    assert {r.doc_id: r.words for r in codec.decompressed(c).collect()} == want
    for form in ("parquet", "json"):
        readers.write_payload(c, str(tmp_path / form), form)
        assert {r.doc_id: r.words for r in readers.read_words(readers.read_payload(spark, str(tmp_path / form), form)).collect()} == want
    assert report.evaluation_summary(readers.sizes(spark, str(tmp_path / "json"), "json")).first().n_errors == 0
    assert codec.decompressed(codec.compressed(docs.where("false"))).count() == 0


def test_stream_length(docs):
    for f in (codec.arithmetic_round_trip, codec.counts_round_trip, codec.rans_round_trip):
        rows = f(docs).collect()
        assert len(rows) == 5 and all(r.ok and r.near_ideal for r in rows)


@given(st.lists(st.integers(0, 1 << 40), max_size=50), st.lists(st.integers(-(1 << 40), 1 << 40), max_size=50), st.lists(st.integers(0, 5), max_size=300))
@settings(max_examples=80, deadline=None)
def test_numbers(a, b, tags):
    assert codec.from_vlq(codec.vlq(a)).tolist() == a
    assert codec.from_zigzag(codec.zigzag(np.array(b, np.int64))).tolist() == b
    assert codec.from_lz77(codec.lz77(tags)) == tags
    assert codec.opened(codec.sealed([codec.vlq(a), b"", bytes(tags)], 1)) == [codec.vlq(a), b"", bytes(tags)]


def bit_by_bit(ranges):
    """The arithmetic code, one bit at a time."""
    low, high, waiting, out = 0, codec.TOP, 0, []

    def put(b):
        out.extend([b] + [1 - b] * waiting)

    for a, b, total in ranges:
        span = high - low + 1
        low, high = low + span * a // total, low + span * b // total - 1
        while True:
            if high < codec.HALF or low >= codec.HALF:
                put(int(low >= codec.HALF))
                waiting = 0
                low, high = low & codec.HALF - 1, high & codec.HALF - 1
            elif low >= codec.QUARTER and high < codec.HALF + codec.QUARTER:
                waiting += 1
                low, high = low - codec.QUARTER, high - codec.QUARTER
            else:
                break
            low, high = low << 1, high << 1 | 1
    waiting += 1
    put(int(low >= codec.QUARTER))
    return codec.packed_bits("".join(map(str, out)))


@given(st.lists(st.integers(0, 4), max_size=300), st.lists(st.integers(1, 9999), min_size=5, max_size=5))
@settings(max_examples=80, deadline=None)
def test_same_bits_as_one_by_one(symbols, counts):
    cum = np.append(0, np.cumsum(counts)).tolist()
    ranges = [(cum[s], cum[s + 1], cum[-1]) for s in symbols]
    data, out = codec.encode_ranges(iter(ranges)), []
    assert data == bit_by_bit(ranges)
    codec.decode_ranges(data, len(symbols), lambda _: cum, out.append)
    assert out == symbols


def test_quantised_ties():
    assert codec.quantised({i: 1 / 5 for i in range(5)}, 8) == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1} or sum(codec.quantised({i: 1 / 5 for i in range(5)}, 8).values()) == 8
    n = codec.quantised({0: 0.375, 1: 0.375, 2: 0.25}, 4)  # 2 + 2 + 1: one too many, taken from the smaller of the equal ones over 1
    assert n == {0: 1, 1: 2, 2: 1}


def test_full_decoder(spark):
    """Named streams in one rANS stream, decoded to sentences."""
    rows, want = [], []
    for i, (words, kind, end) in enumerate([([("dog", 1), ("bark", 2)], 0, "Dogs barked."), ([("go", 0)], 1, "Go?"), ([("run", 3)], 3, "Running!"), ([], 0, "")]):
        line = "_".join(f"^{r}$" for r, _ in words)
        at = [dims.coordinates()[c] for c in line]
        parts = {"sentence_meta": [kind, 0], "morph_code_stream": [c for _, c in words], "char_class_deltas": np.diff([a for a, _ in at], prepend=0).tolist(), "char_pos_deltas": np.diff([b for _, b in at], prepend=0).tolist()}
        flat = [v for name in parts for v in parts[name]]
        p = {v: flat.count(v) / len(flat) for v in set(flat)}
        rows.append((i, bytearray(codec.rans_encode(flat, p)), len(flat), p, {k: len(v) for k, v in parts.items()}))
        want.append(end)
    d = spark.createDataFrame(rows, "doc_id long, state binary, n_symbols long, probabilities map<int,double>, lengths map<string,int>")
    assert [r.text for r in codec.full_decoded(d).orderBy("doc_id").collect()] == want


def test_chains_and_slots(docs):
    got = {(r.doc_id, r.surface): r.n_mentions for r in discourse.chains(docs).collect()}
    assert got == {(6, "Ann Lee"): 3, (6, "Bo"): 2}
    e = {r.doc_id: r for r in discourse.encoded_symbols(docs).collect()}
    assert e[6].encoded.count("§E0;") == 2 and e[6].encoded.count("§E1;") == 1 and all(r.decoded == r.original for r in e.values())
    assert all(r.ok for r in discourse.slotted(docs).collect())
    w = {r.doc_id: r for r in discourse.word_substituted(spark_words(docs)).collect()}
    assert all(r.decoded == r.original for r in w.values()) and w[0].n_symbols == 2 and w[0].encoded.count("§W0;") == 41 and w[0].saved > 0


def spark_words(docs):
    return docs.sparkSession.createDataFrame([(0, "extraordinary things, " * 40 + "§W0; Extraordinary"), (1, "")], "doc_id long, text string").select("doc_id", "text")


def test_splice_drifts_little():
    rng = random.Random(3)
    clean = " ".join("x" * rng.randint(2, 9) for _ in range(400))
    where = sorted((i, "§E0;") for i in rng.sample(range(len(clean)), 20))
    assert discourse.slots(discourse.spliced(clean, where, len(clean))) == (clean, where)
    short = clean.replace("xx xxx", "xxxxx")
    back = discourse.spliced(short, where, len(clean))
    assert discourse.slots(back)[0] == short and back.count("§E0;") == 20


def test_worthy_and_tables(spark):
    m = spark.createDataFrame([(1, "Ann"), (1, "Ann"), (2, "Bob"), (3, "Project License"), (3, "License"), (4, "x" * 30), (4, "x" * 30)], "k long, surface string")
    assert [r.k for r in discourse.worthy(m, ["k"]).collect()] == [1]
    chain = spark.createDataFrame([(1, 0, "Ann"), (1, 1, "Bo")], "doc_id long, entity_id long, surface string")
    assert discourse.symbol_table(chain).first().symbols == {"§E0": "Ann", "§E1": "Bo"}
    assert discourse.places_of("Ann, Anna; Ann's Ann", "Ann") == [0, 17]


def test_noun_phrases(spark):
    t = [(1, 0, i, tag) for i, tag in enumerate(["DET", "ADJ", "NOUN", "VERB", "NOUN", "NOUN", "ADP", "PROPN"])] + [(1, 1, 0, "VERB")]
    got = structure.noun_phrases(spark.createDataFrame(t, "doc_id long, sent_id long, tok_id long, tag string")).collect()
    assert sorted((r.sent_id, r.start, r.end) for r in got) == [(0, 0, 2), (0, 4, 5), (0, 7, 7)]


def test_shapes_get_ids(spark):
    d = spark.createDataFrame([(1, 0, [1, 1], ["det", "ROOT"]), (1, 1, [0], ["ROOT"]), (1, 2, [1, 1], ["det", "ROOT"])], "doc_id long, sent_id long, heads array<int>, deps array<string>")
    s = structure.tree_shapes(d)
    ids = {(r.doc_id, r["shape"]): r.id for r in structure.first_seen_ids(s, "doc_id", ["sent_id"], "shape").collect()}
    assert ids == {(1, "S[ROOT[det]]"): 0, (1, "S[ROOT]"): 1}
    meta = spark.createDataFrame([(2, 1), (9, 0)], "type int, voice int").select(structure.meta_name(F.struct("type", "voice")).alias("m")).collect()
    assert [tuple(r.m) for r in meta] == [("IMPERATIVE", "PASSIVE"), ("DECLARATIVE", "ACTIVE")]


def test_sentence_chunks(spark):
    d = spark.createDataFrame([(1, "Aa bb. Cc dd!\nEe. " + "f" * 20 + ". G."), (2, None), (3, "")], "doc_id long, text string")
    rows = relations.sentence_chunks(d, 14).orderBy("doc_id", "chunk_id").collect()
    got = {}
    for r in rows:
        assert r.chunk_offset == sum(map(len, got.get(r.doc_id, [])))
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {1: ["Aa bb. Cc dd!", "\nEe.", " " + "f" * 20 + ".", " G."], 2: [""], 3: [""]}


def test_own_tagger(docs):
    def load():
        return lambda sentences: [["VERB" if w == "ran" else "NOUN" for w in ws] for ws in sentences]

    got = relations.tokens(docs, load)
    assert got.columns == relations.tokens(docs).columns
    assert {(r.word, r.tag) for r in got.where("doc_id = 0 and word in ('ran', 'The')").collect()} == {("ran", "VERB"), ("The", "NOUN")}


def test_round_trip_command(docs):
    rows = cli.round_trip(docs).collect()
    assert len(rows) == 5 and all(r.n_lost == 0 and r.overlap == 1 and r.first_mismatch is None or r.first_mismatch == -1 for r in rows)


def test_symbol_report_sees_changes(docs, monkeypatch):
    monkeypatch.setattr(discourse, "restore", lambda t, *_: t.replace("§E0;", "someone"))
    r = {x.doc_id: x for x in discourse.symbol_report(docs.where("doc_id = 6")).collect()}[6]
    assert not r.ok and r.first_mismatch >= 0


def test_savings_of_streams():
    lay = streams.Marked(np.array([0, 0, 1]), ["ab", "", "c"], np.array([1, 0, 2]), np.array([7, 7, 15]))
    assert len(lay) == 4 + 3 + 3 and lay.opens.tolist() == [True] + [False] * 6 + [True, False, False]
    assert streams.places(lay.deltas(), lay.opens).tolist() == lay.place.tolist()
