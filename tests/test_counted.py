"""Tables made from shares of documents against the column expressions, on odd rows."""

import pytest
from pyspark.sql import functions as F

from glossa.operators import codec, counted, discourse, model, relations, streams

TEXTS = ["The quick dogs ran home. They were beaten badly, for example because of me!", "", None, "Is it Ünder §E0; the _tree_ ^ 日本語 so?", "a", "   ", "Word. " * 50]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_counts(docs):
    t = relations.tokens(docs).cache()
    p = relations.pairs(t).cache()
    assert rows(counted.char_context(docs)) == rows(model.char_context(p))
    assert rows(counted.morph_context(docs)) == rows(model.morph_context(p))
    assert rows(counted.struct_context(docs)) == rows(model.struct_context(t))
    assert counted.char_context(docs.where("doc_id in (1, 2, 5)")).count() == 0


def test_sentences(docs):
    got = {(r.doc_id, r.sent_id): r for r in counted.syntax(docs).collect()}
    assert [got[0, k].voice for k in (0, 1)] == ["ACTIVE", "PASSIVE"] and got[0, 1].sentence_type == "EXCLAMATORY" and got[3, 0].sentence_type == "INTERROGATIVE"
    assert len(got) == 2 + 1 + 1 + 50
    assert all(len(r.bitstring) == r.n_bits for r in counted.huffman_sentences(docs).collect())
    assert sorted((r.tok_id, r.connective) for r in counted.connectives(docs.where("doc_id = 0")).collect()) == [(4, "for example"), (6, "because")]


def test_a_share_ends_between_ids(docs):
    """Small shares give what one gives, and rows of one id aren't parted."""
    batches = [b for b in streams.worded(docs.union(docs).coalesce(1)).toArrow().to_batches(max_chunksize=3)]
    shares = list(streams.in_shares(iter(batches), 5))
    ids = [d for s in shares for d in s.ids.to_pylist()]
    assert len(shares) > 2 and len(ids) == len(set(ids)) == len(TEXTS)
    assert sum(len(s.tok) for s in shares) == 2 * relations.tokens(docs).count()


def test_exceptions_cost_no_copies(spark):
    """A document of many exceptions is one row with its words, not one a word."""
    d = spark.createDataFrame([(1, "Xs Ys " * 20_000)], "doc_id long, text string")
    back = codec.rebuilt(codec.payload(d, with_words=True))
    assert "Generate" not in back._jdf.queryExecution().executedPlan().toString()
    assert codec.words_returned(back).collect() == [(1, 40_000, True)]


def test_names_meet_their_text_once(docs):
    plan = discourse.encoded_symbols(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    assert discourse.places_of("Ann Anna xAnn Ann's Ann' Ann", "Ann") == [0, 10, 20, 25]
    assert discourse.places_of("so also so", "so", True) == [0, 8]


def test_roots_come_back(docs):
    got = {r.root: r.back for r in counted.returned(counted.roots(docs), "?").collect()}
    assert got["ünd"] == "?nd" and got["日本語"] == "???"
    got = {r.root: r.back for r in counted.returned(counted.roots(docs.where(F.col("doc_id") == 3)), "").collect()}
    assert got["ünd"] == "nd" and got["日本語"] == ""
