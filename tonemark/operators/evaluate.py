"""Accuracy of identification, and reports on fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonemark.functions import audio
from tonemark.sources.synthetic import drawn


def outcomes(results: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, outcome. truth: query_id, fid; a null fid means that the query is in no recording.

    TP: the recording is among the matches. FP: matches without it. FN: no match though there is a recording. TN: none, and there is none.
    """
    got = results.where(F.col("fid").isNotNull()).select("query_id", F.col("fid").alias("found"))
    rows = truth.join(got, "query_id", "left").groupBy("query_id", "fid").agg(F.max((F.col("found") == F.col("fid")).cast("int")).alias("hit"), F.count("found").alias("n"))
    out = F.when(F.coalesce("hit", F.lit(0)) == 1, "TP").when(F.col("n") > 0, "FP").when(F.col("fid").isNull(), "TN").otherwise("FN")
    return rows.select("query_id", out.alias("outcome"))


def metrics(out: DataFrame) -> DataFrame:
    """tp, fp, tn, fn, precision, sensitivity (of the negatives, as the report names it), accuracy; null where a denominator is 0."""
    n = out.agg(*[F.count_if(F.col("outcome") == k.upper()).alias(k) for k in ("tp", "fp", "tn", "fn")])
    ratio = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    return n.select("tp", "fp", "tn", "fn", F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tn, tn + fn), 6).alias("sensitivity"), F.round(ratio(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"))


def rate_histogram(counts: DataFrame) -> DataFrame:
    """n, freq, pdf, bar: how many blocks have n fingerprints. counts: n. bar is relative to the most frequent n."""
    rows = counts.groupBy("n").agg(F.count(F.lit(1)).alias("freq"))
    all_ = Window.partitionBy(F.lit(1))
    return rows.select("n", "freq", F.round(F.col("freq") / F.sum("freq").over(all_), 6).alias("pdf"), F.round(F.col("freq") / F.max("freq").over(all_), 6).alias("bar"))


def noisy(clips: DataFrame, noise: DataFrame, gain: float, noise_gain: float, seed: int = 1) -> DataFrame:
    """Clips (query_id, fid, samples) mixed with a slice of the noise, and snr. noise: samples, in one row.

    The slice starts at a hashed place; both are multiplied by their gains and clamped before they are mixed.
    """
    one = noise.limit(1).select(F.lit(0).alias("k"), F.col("samples").alias("noise"))
    rows = clips.withColumn("k", F.col("query_id") * 0).join(F.broadcast(one), "k").drop("k")
    room = F.greatest(F.size("noise") - F.size("samples"), F.lit(0)) + 1
    start = drawn(room, F.lit(seed), F.col("query_id"))
    rows = rows.withColumn("noise", F.slice("noise", (start + 1).cast("int"), F.size("samples")))
    rows = rows.withColumns({"samples": audio.gain(F.col("samples"), gain), "noise": audio.gain(F.col("noise"), noise_gain)})
    snr = audio.snr(audio.power(F.col("samples")), audio.power(F.col("noise")))
    return rows.select("query_id", "fid", audio.mix(F.col("samples"), F.col("noise")).alias("samples"), snr.alias("snr"))


def mean_snr(clips: DataFrame) -> DataFrame:
    """clips, snr: the ratio over all clips."""
    return clips.agg(F.count(F.lit(1)).alias("clips"), F.avg("snr").alias("snr"))
