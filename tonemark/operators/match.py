"""Candidate search: query batches against postings, scored by similarity and order in time.

A query batch is BATCH fingerprints. Within a batch a term counts once, with its first fingerprint; the search of all recordings
is done on a grid (grid.py). What is asked of a few candidates only is joins and windows over (query, batch, recording, time bin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemark import params as P
from tonemark.functions import terms as T
from tonemark.operators import grid

KEYS = ["query_id", "batch"]


def full_batches(queries: DataFrame) -> DataFrame:
    """Adds batch; only whole batches, and horizon: the last fingerprint received when the batch was complete."""
    rows = queries.withColumn("batch", F.floor(F.col("lid") / P.BATCH).cast("int"))
    last = F.max(F.when(F.col("lid") % P.BATCH == P.BATCH - 1, F.col("block_no"))).over(Window.partitionBy("query_id", "batch"))
    rows = rows.withColumn("done_block", last).where(F.col("done_block").isNotNull())
    ends = queries.groupBy("query_id", F.col("block_no").alias("done_block")).agg(F.max("lid").alias("end"))
    reach = Window.partitionBy("query_id").orderBy("done_block").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("horizon", F.max("end").over(reach)).drop("end")
    return rows.join(ends, ["query_id", "done_block"])


def query_terms(batches: DataFrame) -> DataFrame:
    """query_id, batch, term, k, eq: the first fingerprint of each term in a batch."""
    rows = batches.select(*KEYS, T.single_term(F.col("w"), F.col("f")).alias("term"), "lid", "e")
    return rows.groupBy(*KEYS, "term").agg(F.min(F.struct("lid", "e")).alias("x")).select(*KEYS, "term", F.col("x.lid").alias("k"), F.col("x.e").alias("eq"))


def candidate_hits(candidates: DataFrame, batches: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, batch, k, eq, fid, lid, t, e, bin: the hits of each batch in its candidates (query_id, batch, fid) alone."""
    asked = candidates.select(*KEYS, "fid").join(query_terms(batches), KEYS)
    return asked.join(postings, ["fid", "term"]).select(*KEYS, "k", "eq", "fid", "lid", "t", "e", T.time_bin(F.col("t")).alias("bin"))


def first_hits(rows: DataFrame) -> DataFrame:
    """A query fingerprint scores one fingerprint in each bin of a recording: the first.

    The rows are dealt by query batch and recording: all later steps up to a recording's best bin find them in place.
    Combining before this one shuffle would not pay, as nearly every hit is a first one.
    """
    least = rows.repartition(*KEYS, "fid").groupBy(*KEYS, "fid", "bin", "k").agg(F.min(F.struct("lid", "t", "e", "eq")).alias("x"))
    return least.select(*KEYS, "fid", "bin", "k", F.col("x.lid").alias("lid"), F.col("x.t").alias("t"), F.col("x.e").alias("e"), F.col("x.eq").alias("eq"))


def order_scores(rows: DataFrame) -> DataFrame:
    """Adds score: similarity, and a bonus for coming in order of time after the bin's last one."""
    w = Window.partitionBy(*KEYS, "fid", "bin").orderBy("k")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("ordered", (F.col("t") - F.lag("t", 1, 0).over(w) >= -2).cast("int"))
    out = out.withColumns({"torder": F.sum("ordered").over(so_far), "n": F.row_number().over(w)})
    bonus = F.when(F.col("ordered") == 1, F.floor(P.MAX_SCORE * F.col("torder") / F.col("n"))).otherwise(0)
    return out.withColumn("score", (T.similarity(F.col("eq"), F.col("e")) + bonus).cast("bigint"))


def bin_scores(scored: DataFrame) -> DataFrame:
    """query_id, batch, fid, bin, score, last: the last (k, lid) that scored."""
    return scored.groupBy(*KEYS, "fid", "bin").agg(F.sum("score").alias("score"), F.max(F.struct("k", "lid")).alias("last"))


def top_candidates(best: DataFrame, ties: int = P.TIES["MSCALE"]) -> DataFrame:
    """Recordings over MIN_SCORE with one of the TOP_K largest distinct scores of a batch, at most `ties` with one score."""
    by_score = Window.partitionBy(*KEYS).orderBy(F.desc("score"))
    by_fid = Window.partitionBy(*KEYS, "score").orderBy("fid")
    ranked = best.where(F.col("score") > P.MIN_SCORE).withColumn("place", F.dense_rank().over(by_score)).where(F.col("place") <= P.TOP_K)
    return ranked.withColumn("tie", F.row_number().over(by_fid)).where(F.col("tie") <= ties).drop("tie")


def confidences(top: DataFrame) -> DataFrame:
    """query_id, batch, top1, top2, conf of each batch with candidates."""
    second = F.max(F.when(F.col("place") == 2, F.col("score")))
    rows = top.groupBy(*KEYS).agg(F.max("score").alias("top1"), second.alias("top2"))
    return rows.withColumn("conf", T.batch_confidence(F.col("top1"), F.col("top2")))


def leading(batches: DataFrame, postings: DataFrame) -> DataFrame:
    """Top candidates of all batches; nothing else leaves the tasks that search."""
    return top_candidates(grid.search(query_terms(batches), postings, "top"))


def search(batches: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored hits, bin scores and top candidates of all batches."""
    terms = query_terms(batches)
    return grid.search(terms, postings, "scored"), grid.search(terms, postings, "bins"), leading(batches, postings)


def candidate_scores(candidates: DataFrame, batches: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, batch, fid, bin, k, lid, score: the scored hits of each batch in its candidates."""
    rows = order_scores(first_hits(candidate_hits(candidates, batches, postings)))
    return rows.select(*KEYS, "fid", "bin", "k", "lid", "score")


def peaks(bins: DataFrame, top: DataFrame) -> DataFrame:
    """Bins of candidates that no bin within PEAK_RADIUS exceeds, with half as much again as MIN_SCORE. A bin without hits has score 0."""
    around = Window.partitionBy(*KEYS, "fid").orderBy("bin").rangeBetween(-P.PEAK_RADIUS, P.PEAK_RADIUS)
    rows = bins.join(top.select(*KEYS, "fid"), [*KEYS, "fid"]).withColumn("most", F.max("score").over(around))
    bar: Column = F.lit(P.MIN_SCORE * 3 // 2)
    return rows.where((F.col("score") == F.col("most")) & (F.col("score") > bar)).drop("most", "last")
