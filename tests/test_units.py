"""Fixed examples and invariants of the engine's parts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossa.functions import dims, morph, phonetic, text
from glossa.operators import codec, discourse, model, relations, structure


def col(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_normalised(spark):
    got = col(spark, [None, "", "“A” — b’s\r\n\r\n\r\n\r\nc \td ", "«x» – y"], "string", text.normalised)
    assert got == ["", "", '"A" -- b\'s\n\nc d', '"x" - y']


def test_sentences(spark):
    assert col(spark, ["One. Two! three? Four", ""], "string", text.sentences) == [["One.", "Two! three?", "Four"], []]


@pytest.mark.parametrize(
    "word,root,code",
    [("walked", "walk", 2), ("running", "run", 3), ("dogs", "dog", 1), ("went", "go", 12), ("quickly", "quick", 8), ("under", "der", 9), ("darkness", "darknes", 1), ("most", "most", 0), ("42", "42", 0), ("happiest", "happy", 7), ("bigger", "big", 6), ("tried", "try", 2), ("boxes", "box", 1)],
)
def test_analysed(spark, word, root, code):
    assert tuple(col(spark, [word], "string", morph.analysed)[0]) == (root, code)


def test_applied(spark):
    cases = [("walk", 2, "walked"), ("run", 3, "running"), ("dog", 1, "dogs"), ("quick", 8, "quickly"), ("go", 12, "went"), ("happy", 9, "unhappy"), ("bake", 10, "baker"), ("happy", 11, "happiness"), ("good", 6, "better"), ("happy", 7, "happiest"), ("try", 5, "tries"), ("x", 0, "x")]
    got = spark.createDataFrame(cases, "r string, c int, want string").select(morph.applied(F.col("r"), F.col("c")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_coordinates():
    c = dims.coordinates()
    assert len(c) == 68 and len(set(c.values())) == 68
    assert (c["^"], c["$"], c["."], c["_"], c["0"], c["9"]) == ((6, 0), (6, 1), (6, 3), (5, 34), (5, 35), (5, 44))
    assert dims.coordinates((6, 2))["_"] == (6, 2)


def test_triples(spark):
    a = col(spark, ["aé", "b"], "string", phonetic.triples)
    assert [tuple(x) for x in a[0]] == [(0, 0, 0), (6, 4, 2)] and [tuple(x) for x in a[1]] == [(1, 0, 3)]


def test_factoradic(spark):
    values = [0, 1, 2, 3, 5, 7, 100, -7, 10**15, 2 * 10**18]
    got = col(spark, values, "long", phonetic.factoradic)
    assert [len(x) for x in got[:4]] == [1, 2, 3, 3]
    assert got[3] == [1, 1, 0]
    assert col(spark, got, "array<int>", phonetic.from_factoradic) == values


def test_deltas(spark):
    a = [[3, 1, 1, 7], [], [5]]
    d = col(spark, a, "array<int>", phonetic.deltas)
    assert d == [[3, -2, 0, 6], [], [5]]
    assert col(spark, d, "array<int>", phonetic.running_sums) == a


def test_joined_words(spark):
    cases = [["Hi", ",", "he", "said", "."], ["(", "a", ")"], ["*", "*", "*"], ["don", "'t"], [], ["a", "-", "b"], ["x", "!", '"', "y"]]
    assert col(spark, cases, "array<string>", text.joined_words) == ["Hi, he said.", "(a)", "***", "don't", "", "a-b", 'x! " y']


def test_autocorrected(spark):
    cases = ['" hello', "a - b", "do n't", "x  y", "* * *", "( a )", 'end "." Next']
    assert col(spark, cases, "string", text.autocorrected)[:6] == ['"hello', "a-b", "don't", "x y", "* * *", "(a)"]


def test_tree_shape():
    assert structure.tree_shape([1, 1, 1], ["det", "ROOT", "punct"]) == "S[ROOT[det punct]]"
    assert structure.tree_shape([], []) == "S[]"


def test_sentence_types(spark):
    assert col(spark, ["Is it?", "Go!", "It is."], "string", structure.sentence_type) == ["INTERROGATIVE", "EXCLAMATORY", "DECLARATIVE"]
    df = spark.createDataFrame([(["ROOT", "dobj"], ["VERB", "NOUN"]), (["nsubjpass", "auxpass", "ROOT"], ["NOUN", "AUX", "VERB"])], "d array<string>, p array<string>")
    got = df.select(structure.sentence_type(F.lit("x"), F.col("d"), F.col("p")), structure.voice(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("IMPERATIVE", "ACTIVE"), ("DECLARATIVE", "PASSIVE")]


@given(st.dictionaries(st.sampled_from(dims.POS_TAGS), st.integers(1, 500), min_size=1))
@settings(max_examples=60, deadline=None)
def test_huffman(counts):
    book = structure.huffman(list(counts.items()))
    codes = sorted(book.values())
    assert not any(b.startswith(a) for a, b in zip(codes, codes[1:], strict=False))
    if len(counts) > 1:
        flat = (len(counts) - 1).bit_length()
        assert sum(n * len(book[t]) for t, n in counts.items()) <= flat * sum(counts.values())
    tags = [t for t in counts for _ in range(3)]
    assert structure.decoded_tags("".join(book[t] for t in tags), book) == tags


@given(st.lists(st.integers(0, 6), max_size=400))
@settings(max_examples=60, deadline=None)
def test_coders(symbols):
    counts = {s: symbols.count(s) for s in set(symbols)} or {0: 1}
    t = codec.count_table(counts)
    data = codec.encode(symbols, lambda i: t)
    assert codec.decode(data, len(symbols), lambda so: t) == symbols
    p = {s: n / sum(counts.values()) for s, n in counts.items()}
    assert sum(codec.quantised(p).values()) == 4096
    assert codec.rans_decode(codec.rans_encode(symbols, p), len(symbols), p) == symbols


def test_code_length():
    rng = random.Random(1)
    s = rng.choices(range(4), [0.7, 0.2, 0.05, 0.05], k=20_000)
    import math

    c = {x: s.count(x) for x in set(s)}
    t = codec.count_table(c)
    ideal = -sum(n * math.log2(n / len(s)) for n in c.values())
    assert abs(8 * len(codec.encode(s, lambda i: t)) - ideal) < 64
    with pytest.raises(KeyError):
        codec.encode([9], lambda i: t)
    assert codec.read_archive(codec.frequency_archive(c, b"xyz")) == ({str(k): v for k, v in c.items()}, b"xyz")


def test_substitution():
    t = "Ann Lee met § Ann Lee and Ann Lees; Ann Lee's hat, Ann Lee."
    e = discourse.substitute(t, [(0, "Ann Lee")])
    assert e.count("§E0;") == 2 and discourse.restore(e, [(0, "Ann Lee")]) == t
    r = [(3, "as a result"), (4, "so")]
    t = "so it is, as a result, not also §R4; so"
    e = discourse.substitute(t, [], r)
    assert (e.count("§R4;") - 1, e.count("§R3;")) == (2, 1) and discourse.restore(e, [], r) == t


def test_weights_both_ways(spark):
    docs = spark.createDataFrame([(1, "The quick dogs ran home. They were running."), (2, "No one knows it.")], "doc_id long, text string")
    a = {r.doc_id: r[1:] for r in model.mixing_weights(docs).collect()}
    b = {r.doc_id: r[1:] for r in model.mixing_weights_native(docs).collect()}
    assert a.keys() == b.keys() and all(max(abs(x - y) for x, y in zip(a[k], b[k], strict=True)) < 1e-12 for k in a)


def test_distributions_sum_to_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 20")
    for p, ctx in zip(model.distributions(model.joint(relations.pairs(relations.tokens(docs)))), ("prev", "code", "tag"), strict=True):
        v = p.groupBy("doc_id", ctx).agg(F.sum(p.columns[-1]).alias("s"), F.min(p.columns[-1]).alias("least")).collect()
        assert v and all(abs(r.s - 1) < 1e-6 and r.least > 0 for r in v)


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  \n "), (4, "A b.")], "doc_id long, text string")
    got = {r.doc_id: r for r in model.context_bits(docs).collect()}
    assert got[1].bpb is None and got[2].n_symbols == 0 and got[3].bits == 0 and got[4].bits > 0
    assert model.context_bits(docs.where("false")).count() == 0


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "ab\ncd\n\nefgh"), (2, "abcdefgh"), (3, "")], "doc_id long, text string")
    got = {}
    for r in relations.chunks(docs, 5).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {1: ["ab", "cd\n", "efgh"], 2: ["abcde", "fgh"], 3: [""]}


def test_alphabet(spark):
    a = dims.alphabet(spark)
    x = spark.createDataFrame([("NOUN",), ("?",)], "symbol string")
    got = {r.symbol: r.id for r in dims.symbol_id(a, x).collect()}
    assert got["NOUN"] == a.where("symbol = 'NOUN'").first().id and got["?"] == -1
    assert {r.symbol for r in dims.symbol_name(a, spark.createDataFrame([(0,), (999,)], "id int")).collect()} == {"DECLARATIVE", "UNKNOWN"}
