"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, language_id, licenses, multi_index, packing, quality_rules, sentencepiece_codec, token_counts, toxicity, url_filter
from .license_sql import license_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of the document's id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(remainder(3) != 1))
    found = toxicity.score(docs, model, "doc_id", "text")
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), "page_id", "url", URL_RULES)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 50, 5)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def language_network(docs: DataFrame) -> language_id.Network | None:
    samples = language_id.sample_windows(docs.where(remainder(5) != 0), "doc_id", "text", "lang")
    return language_id.train(samples) if samples else None


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_network(docs), "doc_id", "text")
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), special=True)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_url_filters, op3_sentencepiece, op4_license_scans, op5_nearest_neighbours, op6_quality_rules, op7_language_id, op8_best_fit_packing, op9_ngram_jaccard_join, op10_token_counts)}


#: All links and classes by counting the shared windows of five words of every pair that has one.
JOIN_SQL = """WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM d),
    e AS MATERIALIZED (SELECT r, len(g) AS n, unnest(g) AS g FROM s),
    i AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
    l AS MATERIALIZED (SELECT *, c = n AND c = m AS same FROM i WHERE 10 * c >= 8 * (n + m - c)),
    reach AS (SELECT r, r AS m FROM s UNION SELECT l.a, reach.m FROM reach JOIN l ON l.b = reach.r)
    SELECT s.doc_id, (SELECT min(t.doc_id) FROM reach x JOIN s t ON t.r = x.m WHERE x.r = s.r) AS class_id, (SELECT count(*) FROM l WHERE l.a = s.r) AS n_links,
    least(s.doc_id, coalesce((SELECT min(t.doc_id) FROM l JOIN s t ON t.r = l.b WHERE l.a = s.r AND l.same), s.doc_id)) AS copy_id FROM s"""

ORACLE_SQL: dict[str, str] = {"op4_license_scans": license_sql(), "op9_ngram_jaccard_join": JOIN_SQL}
