"""Prepares documents for training: language, quality, near duplicates, packing.

Each stage is a function of (spark, docs, sf_dir) whose result is written and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemark.llm import jaccard_join, language_id, packing, quality_rules
from tonemark.llm.common import materialize
from tonemark.llm.queries import language_network

#: Probability that a text's language must have.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those of which no language has LEAST_SCORE.

    A null, empty or letterless text goes; null ids, languages and sources stay; repeated rows are judged alike; ties go to the
    language that comes first; without labelled rows, or in an empty table, nothing is left. Columns of any name and type are carried along.
    """
    columns = docs.columns
    mark = reduce(lambda name, _: name + "_" if name in columns else name, columns, "lang_pred_id")
    found = language_id.identify(docs.withColumn(mark, F.col("doc_id")), language_network(docs), mark, "text", keep=columns)
    # the prediction stands between the id and the kept columns, some of which may have its names
    found = found.toDF("id", "pred", "sure", *[f"k{i}" for i in range(len(columns))])
    kept = found.where((F.col("pred") != language_id.UNKNOWN) & (F.col("sure") >= LEAST_SCORE))
    return kept.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules, and outliers of their language and source.

    A null or empty text has no words and goes; a null language or source is a group of its own; repeated rows are judged
    alike; an empty table gives none. Columns of any name and type are carried along.
    """
    columns = docs.columns
    judged = quality_rules.quality(docs, keep=tuple(columns))
    judged = judged.toDF(*[f"q{i}" for i in range(len(judged.columns) - len(columns) - 1)], "kept", *[f"k{i}" for i in range(len(columns))])
    return judged.where("kept").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that with the least doc_id, rows without one last, and of several texts under this id one of the class.

    Of equal rows one stays. A text without words (null, empty, blank) is in no class: each such row stays. Rows of one
    doc_id with texts that aren't near are told apart. An empty table gives none. Columns of any name and type are carried along.
    """
    row = lambda: F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text"))
    found = jaccard_join.near_duplicates(docs.select(row().alias("row"), "text"), "row")
    first = found.where(F.col("row") == F.col("class_id")).select(F.col("row").alias("first"), (F.col("n_links") > 0).alias("linked")).distinct()
    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(docs.columns)]
    named = docs.select(row().alias("row"), *columns).join(first, F.col("row") == F.col("first"))
    kept = named.where("linked").dropDuplicates(["row"]).union(named.where("not linked"))
    return kept.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is the end id alone; null ids and repeated rows are packed like others; an empty table gives none; other columns are not read.
    """
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), special=True)


STAGES = [("language ID", language), ("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("best-fit packing", pack)]

#: No SQL expresses the network or the joins; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
