"""The queries opN_<name>: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glossa.llm import bpe, embed_dedup, license, lm, packing, pii, simhash, substring, syncmers, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup_substrings(_table(spark, sf_dir)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_lm_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(_table(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (op1_byte_bpe, op2_embedding_dedup, op3_substring_dedup, op4_simhash, op5_packing, op6_lm_lattice, op7_syncmers, op8_pii, op9_license_scan, op10_toxicity)
    }


#: Fingerprints (XXH64), merges of ranks, learned scores and hashed anchors have no DuckDB SQL; tests/llm holds
#: those queries against brute force.
_PAIRS = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY 1),
n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, vec_id = low AS kept
FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""

_WINDOWS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT r, unnest(range(len(ws))) AS i, unnest(ws) AS word, len(ws) AS n FROM d),
h AS (SELECT r, i, n, word, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM t),
again AS (SELECT h FROM h WHERE i <= n - 35 GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT r, i, word, (i <= n - 35 AND again.h IS NOT NULL)::INT AS starts FROM h LEFT JOIN again ON h.h = again.h),
c AS (SELECT r, i, word, max(starts) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM s),
k AS (SELECT r, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": _PAIRS, "op3_substring_dedup": _WINDOWS}
