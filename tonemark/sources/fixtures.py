"""Engine inputs made from the test tables by integer arithmetic, so that SQL can make the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frames of a step of identification (1.8 s); the slice of a recording that is asked for; customers whose orders make a stream.
STEP_FRAMES = 130
FIRST, LAST, STREAM = 100, 219, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, lid, t, f, w, e: a recording for each supplier, a fingerprint for each of its line items."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    rows = rows.withColumn("lid", (F.row_number().over(w) - 1).cast("int"))
    return rows.select(
        (F.col("l_suppkey") + 1).cast("int").alias("fid"),
        "lid",
        (4 * F.col("lid") + F.col("l_linenumber") % 3).cast("int").alias("t"),
        (36 + (F.col("l_partkey") * 37 + F.col("l_orderkey")) % 521).cast("int").alias("f"),
        ((F.col("l_partkey") * 31 + F.col("l_linenumber") * 17) % 100).cast("int").alias("w"),
        (50 + F.col("l_orderkey") % 206).cast("int").alias("e"),
    )


def query_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, block_no, lid, t, f, w, e of the query set: a distorted slice of each recording whose number is divisible by ten, and,
    as queries that are in no recording, the streams of orders of each customer whose number is. Both grow with the tables."""
    own = corpus(spark, sf_dir).where((F.col("fid") % 10 == 0) & F.col("lid").between(FIRST, LAST))
    own = own.withColumn("lid", (F.col("lid") - FIRST).cast("int")).withColumn("t", (F.col("t") - 4 * FIRST).cast("int"))
    return _queries(own, _streams(spark, sf_dir, 10))


def all_query_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like query_fingerprints, for a slice of every recording and the orders of all customers. A recording that ends before LAST gives its last rows, at most as many."""
    length = LAST - FIRST + 1
    rows = corpus(spark, sf_dir)
    ends = F.max("lid").over(Window.partitionBy("fid")) + 1
    own = rows.withColumn("start", F.greatest(F.lit(0), F.least(F.lit(FIRST), ends - length)))
    own = own.where(F.col("lid").between(F.col("start"), F.col("start") + length - 1))
    own = own.withColumn("lid", (F.col("lid") - F.col("start")).cast("int")).withColumn("t", (F.col("t") - 4 * F.col("start")).cast("int"))
    return _queries(own, _streams(spark, sf_dir, 1))


def _streams(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    """Orders of the customers whose number is divisible by `every`: those of STREAM such customers are a stream."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").where(F.col("o_custkey") % every == 0)
    rows = rows.withColumn("query_id", (1_000_000 + F.floor(F.col("o_custkey") / (STREAM * every))).cast("int"))
    return rows.withColumn("lid", (F.row_number().over(Window.partitionBy("query_id").orderBy("o_orderkey")) - 1).cast("int"))


def _queries(own: DataFrame, rows: DataFrame) -> DataFrame:
    own = own.select(
        F.col("fid").alias("query_id"),
        "lid",
        "t",
        "f",
        F.when(F.col("lid") % 5 == 0, (F.col("w") + 1) % 100).otherwise(F.col("w")).cast("int").alias("w"),
        "e",
    )
    other = rows.select(
        "query_id",
        "lid",
        (4 * F.col("lid") + F.col("o_orderkey") % 3).cast("int").alias("t"),
        (36 + (F.col("o_orderkey") * 53 + F.col("o_custkey") * 7) % 521).cast("int").alias("f"),
        ((F.col("o_orderkey") * 13 + F.col("o_custkey") * 29) % 100).cast("int").alias("w"),
        (50 + F.col("o_custkey") % 206).cast("int").alias("e"),
    )
    both = own.unionByName(other)
    return both.withColumn("block_no", F.floor(F.col("t") / STEP_FRAMES).cast("int")).select("query_id", "block_no", "lid", "t", "f", "w", "e")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).cast("int").alias("fid"), F.col("s_name").alias("meta"))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point, label, bits (0 or 1 for each component that is positive) and the same as one 64-bit word."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point"), "label", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("bits"))
    word = F.aggregate("bits", F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("bigint")))
    return rows.withColumn("word", word)
