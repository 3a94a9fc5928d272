"""Binary vectors: Hamming distance, nearest codeword, and k-medians by majority of bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark import params as P
from tonemark.errors import InvalidCodebook
from tonemark.plans.scratch import materialize


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two words, or of two arrays of words."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def pack_words(descriptor: Column, n_bytes: int = P.BYTES) -> Column:
    """A binary column as 64-bit words, for hamming_words."""
    text = F.rpad(F.hex(descriptor), -(-n_bytes // 8) * 16, "0")
    return F.transform(F.sequence(F.lit(0), F.lit(-(-n_bytes // 8) - 1)), lambda i: F.conv(F.substring(text, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))


def codewords(codebook: DataFrame) -> list[tuple[int, int]]:
    """(code, centroid) of a codebook, which has at most P.WORDS rows."""
    rows = codebook.select("code", "centroid").limit(P.WORDS + 1).collect()
    if len(rows) > P.WORDS:
        raise InvalidCodebook(f"a codebook has at most {P.WORDS} codewords")
    return sorted((r["code"], r["centroid"]) for r in rows)


def nearest(word: Column, book: list[tuple[int, int]], largest: bool = True) -> Column:
    """struct<d, c> of the nearest codeword; of equally near ones the largest number, or else the smallest. One expression: no row is multiplied."""
    sign = -1 if largest else 1
    best = F.array_min(F.array(*[F.struct(hamming(word, F.lit(c).cast("bigint")).alias("d"), F.lit(sign * i).alias("c")) for i, c in book]))
    return F.struct(best["d"].alias("d"), (best["c"] * sign).cast("int").alias("c"))


def nearest_word(points: DataFrame, codebook: DataFrame, bits: int) -> DataFrame:
    """points (word) and codebook (code, centroid): adds code and dist, clipped to MAX_ERROR. Of equal codewords the largest number wins."""
    near = points.withColumn("x", nearest(F.col("word"), codewords(codebook)))
    return near.select(*points.columns, F.col("x.c").alias("code"), F.least(F.col("x.d"), F.lit(min(P.MAX_ERROR, bits))).cast("int").alias("dist"))


_COUNTS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def codes(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each descriptor and its distance, clipped; of equally near ones the largest. x, codebook: (n, BYTES) uint8; a table of 256 bit counts serves the distance."""
    w, e = np.zeros(len(x), dtype=np.int32), np.zeros(len(x), dtype=np.int32)
    for a in range(0, len(x), 256):
        dist = _COUNTS[x[a : a + 256, None, :] ^ codebook[None]].sum(axis=2, dtype=np.int32)
        best = dist.shape[1] - 1 - dist[:, ::-1].argmin(axis=1)
        w[a : a + 256], e[a : a + 256] = best, np.minimum(dist[np.arange(len(dist)), best], P.MAX_ERROR)
    return w, e


def quantize_udf(codebook: np.ndarray):
    """For whole descriptors: a pandas function from binary to struct<w int, e int>."""

    @F.pandas_udf("w int, e int")
    def quantize(d: pd.Series) -> pd.DataFrame:
        w, e = codes(np.frombuffer(b"".join(d), dtype=np.uint8).reshape(len(d), -1), codebook)
        return pd.DataFrame({"w": w, "e": e})

    return quantize


def bit_majority(points: DataFrame, by: str, width: int = 64) -> DataFrame:
    """by, centroid: the word of the bits that most of a group's points have; a tie gives 0. points: by, bits (array of 0 and 1).

    The bits are counted as columns of one aggregation; no row is multiplied. The first component is the highest bit.
    """
    counts = points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("bits", F.lit(i))).alias(f"b{i}") for i in range(width)])
    word = F.lit(0).cast("bigint")
    for i in range(width):
        word = F.shiftleft(word, 1).bitwiseOR((2 * F.coalesce(F.col(f"b{i}"), F.lit(0)) > F.col("n")).cast("bigint"))
    return counts.select(by, word.alias("centroid"))


def duplicate_codewords(codebook: DataFrame) -> DataFrame:
    """duplicates: codewords that equal another, but for the first of each."""
    return codebook.groupBy("centroid").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def least_distances(points: DataFrame, chosen: list[int], bits: int = 64) -> DataFrame:
    """Adds d: the distance of each point (word) from the nearest of the chosen words, by which the next one is drawn."""
    return points.withColumn("d", F.least(*[hamming(F.col("word"), F.lit(c).cast("bigint")) for c in chosen], F.lit(bits)))


def seeds(points: DataFrame, k: int, how: str = "distance", seed: int = 1, sample: int = 20_000) -> list[int]:
    """k words to start from. random: those of the points that come first by a hash. distance: from a bounded sample of the
    points, each next one with a chance in proportion to its distance from the nearest chosen one."""
    order = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("point").cast("string")))
    if how == "random":
        return [r["word"] for r in points.select("word", order.alias("h"), "point").orderBy("h", "point").limit(k).collect()]
    words = np.array([r["word"] for r in points.select("word", order.alias("h"), "point").orderBy("h", "point").limit(sample).collect()], dtype=np.int64).view(np.uint64)
    if not len(words):
        return []
    rng = np.random.default_rng(seed)
    chosen = [words[0]]
    near = np.bitwise_count(words ^ chosen[0]).astype(float)
    while len(chosen) < k and near.sum() > 0:
        chosen.append(words[int(rng.choice(len(words), p=near / near.sum()))])
        near = np.minimum(near, np.bitwise_count(words ^ chosen[-1]))
    return [int(c) for c in np.array(chosen, dtype=np.uint64).view(np.int64)]


def kmedians(points: DataFrame, k: int, rounds: int = 32, tolerance: float = 0.01, seed: int = 1, seeding: str = "distance") -> DataFrame:
    """code, centroid, sum_d, n_points: binary k-medians of points (point, word, bits), until at most the tolerated share changes.

    Only the k centroids are on the driver; an assignment is one expression over them, a new centroid a sum for each bit.
    sum_d and n_points are those of the last assignment.
    """
    spark = points.sparkSession
    points = materialize(points.select("point", "word", "bits"), "kmedians-points")
    chosen = seeds(points, k, seeding, seed)
    before = None
    for _ in range(rounds):
        near = points.withColumn("x", nearest(F.col("word"), list(enumerate(map(int, chosen))), largest=False))
        now = materialize(near.select("point", "word", "bits", F.col("x.c").alias("code"), F.col("x.d").alias("d")), "kmedians-near")
        total = now.count()
        changed = total if before is None else now.join(before.select("point", F.col("code").alias("old")), "point").where("code <> old").count()
        fresh = {r["code"]: r["centroid"] for r in bit_majority(now, "code").collect()}
        chosen = [fresh.get(i, c) for i, c in enumerate(chosen)]
        before = now
        if changed <= tolerance * total:
            break
    stats = before.groupBy("code").agg(F.sum("d").cast("double").alias("sum_d"), F.count(F.lit(1)).alias("n_points"))
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(chosen)], "code int, centroid bigint").join(stats, "code", "left").select("code", "centroid", F.coalesce("sum_d", F.lit(0.0)).alias("sum_d"), F.coalesce("n_points", F.lit(0)).cast("bigint").alias("n_points"))
