"""Evidence over batches, confidence over steps, classification and the first decision of each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemark import params as P
from tonemark.functions import terms as T


def accumulated(parts: DataFrame, batches: DataFrame) -> DataFrame:
    """query_id, batch, fid, ac, bin: each recording's score and latest bin after each batch. parts: what batches add (score, bin)."""
    grid = batches.select("query_id", "batch").distinct()
    ends = grid.groupBy("query_id").agg(F.max("batch").alias("end"))
    w = Window.partitionBy("query_id", "fid").orderBy("batch")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.select("query_id", "batch", "fid", "bin", F.sum("score").over(so_far).cast("bigint").alias("ac"), (F.lead("batch").over(w) - 1).alias("until"))
    # a sum stands until the recording's next one
    lasting = sums.join(ends, "query_id").withColumn("until", F.coalesce("until", F.greatest("batch", "end")))
    rows = lasting.select("query_id", F.explode(F.sequence("batch", "until")).alias("batch"), "fid", "ac", "bin")
    return rows.join(grid, ["query_id", "batch"], "left_semi")


def final_top(acc: DataFrame, k: int = P.TOP_K) -> DataFrame:
    """Adds place: recordings with one of the k largest distinct scores after each batch."""
    w = Window.partitionBy("query_id", "batch").orderBy(F.desc("ac"))
    return acc.withColumn("place", F.dense_rank().over(w)).where(F.col("place") <= k)


def steps(queries: DataFrame, batches: DataFrame, dur: float) -> DataFrame:
    """query_id, block_no, batch, id_time: every step of a query; batch is the last one completed in it, else null."""
    last = queries.groupBy("query_id").agg(F.max("block_no").alias("n"))
    rows = last.select("query_id", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("block_no"))
    done = batches.groupBy("query_id", F.col("done_block").alias("block_no")).agg(F.max("batch").alias("batch"))
    return rows.join(done, ["query_id", "block_no"], "left").withColumn("id_time", (F.col("block_no") + 1) * F.lit(dur))


def best_of_steps(step: DataFrame, top: DataFrame) -> DataFrame:
    """query_id, block_no, fid, ac, bin, conf for the best recordings (there may be ties) of each step with a batch."""
    w = Window.partitionBy("query_id", "batch")
    rows = top.withColumns({"top1": F.max("ac").over(w), "top2": F.max(F.when(F.col("place") == 2, F.col("ac"))).over(w)}).where(F.col("place") == 1)
    rows = rows.withColumn("conf", T.step_confidence(F.col("top1"), F.col("top2")))
    return step.where(F.col("batch").isNotNull()).join(rows, ["query_id", "batch"]).select("query_id", "block_no", "id_time", "fid", "ac", "bin", "conf")


def running(best: DataFrame, dur: float) -> DataFrame:
    """Adds mean_conf and acc_time: mean confidence, and time, over the steps in which a recording was the best."""
    w = Window.partitionBy("query_id", "fid").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    return best.withColumns({"mean_conf": F.avg("conf").over(w), "acc_time": F.count(F.lit(1)).over(w) * F.lit(dur)})


def memberships(conf: Column, time: Column, mode: str) -> dict[str, Column]:
    """Degree of each fuzzy set, 0 to 1."""
    c = P.FUZZY[mode]

    def falls(x: Column, a: float, b: float) -> Column:
        return F.when(x <= a, 1.0).otherwise(F.greatest(F.lit(0.0), (b - x) / (b - a)))

    def rises(x: Column, a: float, b: float) -> Column:
        return F.when(x >= b, 1.0).otherwise(F.greatest(F.lit(0.0), (x - a) / (b - a)))

    def peaks(x: Column, a: float, b: float, d: float) -> Column:
        return F.when(x <= b, F.greatest(F.lit(0.0), (x - a) / (b - a))).otherwise(F.greatest(F.lit(0.0), (d - x) / (d - b)))

    return {"low": falls(conf, *c["low"]), "med": peaks(conf, *c["med"]), "high": rises(conf, *c["high"]), "short": falls(time, *c["short"]), "mid": peaks(time, *c["mid"]), "long": rises(time, *c["long"])}


def classify(conf: Column, time: Column, mode: str = "EASY") -> Column:
    """Class by the fuzzy rules: and is the minimum, or the maximum; of equal degrees the first class wins."""
    m = memberships(conf, time, mode)
    both = lambda a, b: F.least(m[a], m[b])
    degree = {
        "UNIDENTIFIED": both("low", "long"),
        "SOUNDS_LIKE": both("med", "long"),
        "IDENTIFIED": F.greatest(both("high", "mid"), both("high", "long")),
        "LISTENING": F.greatest(both("high", "short"), both("med", "short"), both("med", "mid"), both("low", "short"), both("low", "mid")),
    }
    most = F.greatest(*degree.values())
    out = F.when(degree["UNIDENTIFIED"] == most, "UNIDENTIFIED")
    for name in P.CLASSES[1:]:
        out = out.when(degree[name] == most, name)
    return out


def fuzzy_steps(step: DataFrame, best: DataFrame, dur: float, mode: str) -> DataFrame:
    """A row for each step and best recording, or for a step without one: its class."""
    time = F.when(F.col("id_time") < P.MAX_ID_TIME, F.col("acc_time")).otherwise(F.col("id_time"))
    known = running(best, dur).withColumn("class", classify(F.col("mean_conf"), time, mode))
    rest = step.join(best.select("query_id", "block_no").distinct(), ["query_id", "block_no"], "left_anti")
    none = rest.select("query_id", "block_no", "id_time").withColumn("class", classify(F.lit(0.0), F.col("id_time"), mode))
    return known.unionByName(none, allowMissingColumns=True)


def first_decisions(classed: DataFrame) -> DataFrame:
    """The rows of each query's first step that has a class other than LISTENING."""
    final = classed.where(F.col("class") != "LISTENING")
    first = F.min("block_no").over(Window.partitionBy("query_id"))
    return final.withColumn("first", first).where(F.col("block_no") == F.col("first")).drop("first")


def results(decided: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, status, fid, confidence, score, id_class, cue_point, id_time: one row for each match, or one that says there is none."""
    ids = queries.select("query_id").distinct()
    matched = decided.where(F.col("class").isin("IDENTIFIED", "SOUNDS_LIKE"))
    got = matched.select("query_id", "fid", F.round("mean_conf", 6).alias("confidence"), F.round(F.col("ac") / 1000, 3).alias("score"), F.col("class").alias("id_class"), T.cue_point(F.col("bin")).alias("cue_point"), F.round("id_time", 6).alias("id_time"))
    gone = decided.groupBy("query_id").agg(F.max("id_time").alias("t"))
    rows = ids.join(got, "query_id", "left").join(gone, "query_id", "left")
    status = F.when(F.col("fid").isNotNull(), "MATCH").when(F.col("t").isNotNull(), "NO_MATCH").otherwise("PENDING")
    return rows.select("query_id", status.alias("status"), "fid", "confidence", "score", "id_class", "cue_point", F.coalesce("id_time", F.round("t", 6)).alias("id_time"))


def binary_decisions(step: DataFrame, best: DataFrame, threshold: float = 0.9, min_time: float = 0.0) -> DataFrame:
    """First step whose confidence reaches the threshold after min_time; a step with a batch at MAX_ID_TIME ends without a match."""
    hit = best.where((F.col("conf") >= threshold) & (F.col("id_time") >= min_time)).withColumn("class", F.lit("IDENTIFIED")).withColumn("mean_conf", F.col("conf"))
    over = step.where(F.col("batch").isNotNull() & (F.col("id_time") >= P.MAX_ID_TIME)).select("query_id", "block_no", "id_time").withColumn("class", F.lit("UNIDENTIFIED"))
    over = over.join(hit.select("query_id", "block_no").distinct(), ["query_id", "block_no"], "left_anti")
    return first_decisions(hit.unionByName(over, allowMissingColumns=True))
