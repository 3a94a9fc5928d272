"""Seeded synthetic inputs: recordings of random fingerprints, and audio of gliding tones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonemark import params as P


def drawn(m: int | Column, *key: Column) -> Column:
    """A number below m, the same for the same key: the first 32 bits of a hash that SQL engines have, too."""
    text = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]))
    return F.pmod(F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint"), m if isinstance(m, Column) else F.lit(m))


def recordings(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """fid, lid, t, f, w, e: n recordings of 240 to 420 seconds with 15 to 25 fingerprints in each, at distinct times and frequencies."""
    u = lambda k, m, *c: drawn(m, F.lit(seed), F.lit(k), *c)
    recs = spark.range(1, n + 1).select(F.col("id").cast("int").alias("fid"))
    secs = recs.withColumn("s", F.explode(F.sequence(F.lit(0), 239 + u(1, 181, F.col("fid")))))
    cells = secs.withColumn("j", F.explode(F.sequence(F.lit(0), 14 + u(2, 11, F.col("fid"), F.col("s")))))
    key = (F.col("fid"), F.col("s"), F.col("j"))
    cells = cells.select("fid", (F.col("s") * 73 + u(3, 73, *key)).cast("int").alias("t"), (P.K_MIN + u(4, P.K_MAX - P.K_MIN + 1, *key)).cast("int").alias("f")).distinct()
    w = Window.partitionBy("fid").orderBy("t", "f")
    at = (F.col("fid"), F.col("t"), F.col("f"))
    return cells.select("fid", (F.row_number().over(w) - 1).cast("int").alias("lid"), "t", "f", u(5, P.WORDS, *at).cast("int").alias("w"), (50 + u(6, 206, *at)).cast("int").alias("e"))


def tones(spark: SparkSession, n: int, seconds: float = 12.0, seed: int = 1) -> DataFrame:
    """fid, samples: recordings of short tones of hashed pitches, five in a second, with a little noise."""
    size = int(seconds * P.SAMPLE_RATE)
    slot = P.SAMPLE_RATE // 5
    h = lambda k, m, fid, i: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), fid, F.floor(i / slot)), F.lit(m))

    def sample(fid):
        def at(i):
            tone = lambda k: F.sin(2 * 3.141592653589793 * (300 + h(k, 2400, fid, i)) * i / P.SAMPLE_RATE)
            shape = F.sin(3.141592653589793 * (i % slot) / slot)
            noise = (F.pmod(F.xxhash64(fid, i), F.lit(2001)) - 1000) / 200000.0
            return (0.3 * shape * (tone(1) + tone(2)) + noise).cast("float")

        return at

    rows = spark.range(1, n + 1).select(F.col("id").cast("int").alias("fid"))
    return rows.select("fid", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), sample(F.col("fid"))).alias("samples"))


def clips(recs: DataFrame, per: int, length: int, seed: int = 1) -> DataFrame:
    """query_id, fid, start, samples: `per` seeded slices of `length` samples of each recording (fid, samples), of the whole where it is shorter."""
    room = F.greatest(F.size("samples") - length, F.lit(0)) + 1
    cut = recs.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    cut = cut.withColumn("start", drawn(room, F.lit(seed), F.col("fid"), F.col("c")).cast("int"))
    return cut.select((F.col("fid") * per + F.col("c")).cast("int").alias("query_id"), "fid", "start", F.slice("samples", F.col("start") + 1, F.lit(length)).alias("samples"))
