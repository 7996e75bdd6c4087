"""The pipeline's stages against the operators' brute force, stage by stage, on a small table."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from glossa.llm import pii, simhash, toxicity


@pytest.fixture(scope="module")
def start(spark, sf, tmp_path_factory):
    to = tmp_path_factory.mktemp("tables")
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    more = spark.createDataFrame([(900, None, "en", "s", None), (901, "", "en", "s", 0), (902, "write to a@b.org", "en", "s", 16), (902, "write to a@b.org", "en", "s", 16), (None, "an unnumbered text of some words", None, None, None)], d.schema)
    d.union(more).write.parquet(f"{to}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{to}/labels.parquet")
    return str(to)


def test_stages(spark, start):
    docs = spark.read.parquet(f"{start}/documents.parquet")
    for name, stage in C.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, start)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == C.COLUMNS
        if name == "toxicity":
            g = toxicity.learn(spark.read.parquet(f"{start}/documents.parquet"), spark.read.parquet(f"{start}/labels.parquet"))
            assert sorted(map(str, after)) == sorted(str(r) for r in before if g.score(r.text or "") < 0.5)
        if name == "simhash":
            comp = simhash.near_duplicates(spark.createDataFrame(before, docs.schema)).collect()
            assert len(after) == len({r.component_id for r in comp}) and {r.doc_id for r in after} == {r.component_id for r in comp}
        if name == "substring":
            want = {r.doc_id: b for r, b in zip(before, brute.windows([r.text for r in before]), strict=True)}
            for r in after:
                assert len((r.text or "").split()) == want[r.doc_id][0] - want[r.doc_id][1]
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert all(want[i][0] == want[i][1] > 0 for i in gone)
        if name == "pii":
            was = {r.doc_id: r for r in before}
            assert len(after) == len(before)
            assert all(r.text == (None if was[r.doc_id].text is None else pii.redacted(was[r.doc_id].text)) for r in after)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        if name == "packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            tokens = {(r.doc_id, r.doc_tokens) for r in after}
            assert sum(r.length for r in after) == sum(n for _, n in tokens)


def test_run(spark, start):
    got = C.run(spark, start).agg(F.count("*").alias("n"), F.max("sequence_id").alias("m")).first()
    assert got.n > 50 and got.m >= 0


def test_one_of_each_group(spark):
    """Missing and repeated ids join no groups, and each group keeps one row."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (None, c), (4, c), (5, d), (7, a + " z"), (7, e), (3, e), (7, d.upper()), (8, "x"), (8, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en" if k % 2 else None, "s", len(t)) for k, (i, t) in enumerate(rows)], schema)
    docs = docs.union(spark.createDataFrame([(None, f"only {k} " + a.replace("a", chr(65 + k) * 2), None, None, None) for k in range(5)], schema))
    fp = {r.text: simhash.fingerprint(r.text.encode()) for r in docs.collect()}
    far = [fp[t] for t in fp if t not in (a + " z", d.upper())]
    assert all((x ^ y).bit_count() > 3 for i, x in enumerate(far) for y in far[:i]) and fp[d] == fp[d.upper()]
    near = (fp[a] ^ fp[a + " z"]).bit_count() <= 3
    got = sorted((r.doc_id or 0, r.text) for r in C.near_duplicates(spark, docs, "").collect())
    want = [(0, b), (4, c), (5, d), (7, a + " z"), (3, e), (8, "x"), *([] if near else [(0, a)])]
    assert got == sorted(want + [(0, t) for t in fp if t.startswith("only")])


def test_stages_on_odd_tables(spark, start):
    """Empty tables, long texts, repeated rows, nulls in every column, and extra columns with names of ours."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    rows = [(1, long_text, "en", "s", len(long_text)), (None, None, None, None, None), (None, None, None, None, None), (2, "", None, "s", 0), (3, "one two", "en", None, 7), (3, "one two", "en", None, 7), (None, "unnumbered", "en", "s", None)]
    wide = spark.createDataFrame(rows, schema).withColumns({c: F.lit("own") for c in ("rk", "row", "fp", "kept", "salt", "r", "toxic", "factors")})
    for name, stage in C.STAGES:
        assert stage(spark, wide.where("false"), start).count() == 0
        out = stage(spark, wide, start).collect()
        if name == "packing":
            assert sum(r.length for r in out if r.doc_id == 1) == max(r.doc_tokens for r in out if r.doc_id == 1)
            assert len([r for r in out if r.doc_id == 3]) == 2
            continue
        texts = [r.text for r in out]
        assert long_text in texts and texts.count("one two") == (1 if name == "simhash" else 2)
        assert texts.count(None) == (0 if name == "simhash" else 2) and "" in texts  # one of the texts without words
        assert all(len(r) == 5 for r in out)
