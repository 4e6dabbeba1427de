"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qscope.llm import fingerprint, jaccard_join, langid, lm_score, media, mixing, packing, sharding, suffix_dedup, token_io
from qscope.llm.common import ship


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file is; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"), links_too=False).select("doc_id", "n_shingles", "component_id")


def op2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(read(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.token_files(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(read(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1,
    "op2_ngram_jaccard_join": op2,
    "op2_ngram_jaccard_links": op2_links,
    "op3_suffix_array_dedup": op3,
    "op4_minhash_fingerprint": op4,
    "op5_mix_sources": op5,
    "op6_token_planes": op6,
    "op7_language_id": op7,
    "op8_media_sniff": op8,
    "op9_feistel_shards": op9,
    "op10_best_fit_pack": op10,
}

#: DuckDB: shingles as text, all pairs that share one, and components by reachability.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * p.c >= 80 * (i.c + j.c - p.c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.c, 0) AS n_shingles, q.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) q ON q.x = w.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard_join": JACCARD_SQL, "op5_mix_sources": mixing.ORACLE}
