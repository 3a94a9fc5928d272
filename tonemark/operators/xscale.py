"""Candidate search by pairs of fingerprints. Scoring a recording is a fold in order of the query's pairs, one pass over sorted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark import params as P
from tonemark.functions import terms as T
from tonemark.operators import index
from tonemark.operators.match import KEYS


def query_pairs(batches: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, batch, term, k, j, eq: the first pair (k, j) of each term in a batch; j may lie beyond the batch, up to the horizon."""
    rows = index.pairs(queries.select("query_id", "lid", "t", "f", "w", "e"), ["query_id"]).select("query_id", "lid", "term", "lid2", "e")
    both = rows.join(batches.select(*KEYS, "lid", "horizon"), ["query_id", "lid"]).where(F.col("lid2") <= F.col("horizon"))
    return both.groupBy(*KEYS, "term").agg(F.min(F.struct("lid", "lid2", "e")).alias("x")).select(*KEYS, "term", F.col("x.lid").alias("k"), F.col("x.lid2").alias("j"), F.col("x.e").alias("eq"))


def hits(terms: DataFrame, postings: DataFrame) -> DataFrame:
    return terms.join(postings, "term").select(*KEYS, "fid", T.time_bin(F.col("t")).alias("bin"), "k", "j", "lid", "t", "e", "eq")


FOLD = "struct<owner:map<int,int>,score:bigint,ordered:int,t:int,k:int,j:int,lid:int>"


def _add(now: Column, x: Column) -> Column:
    """One more pair of a bin, in order. A fingerprint belongs to the first pivot that claims it; a pair scores once."""
    owner = F.element_at(now["owner"], x["lid"])
    takes = ~((now["k"] == x["k"]) & (now["j"] == x["j"])) & F.coalesce(owner == x["k"], F.lit(True))
    held = F.when(owner.isNull(), F.map_concat(now["owner"], F.create_map(x["lid"], x["k"]))).otherwise(now["owner"])
    in_order = x["t"] - now["t"] >= -2
    ordered = now["ordered"] + in_order.cast("int")
    n = F.size(now["owner"]) + owner.isNull().cast("int")
    score = now["score"] + T.similarity(x["eq"], x["e"]) + F.when(in_order, F.floor(P.MAX_SCORE * ordered / n)).otherwise(0)
    new = F.struct(held.alias("owner"), score.cast("bigint").alias("score"), ordered.alias("ordered"), x["t"].alias("t"), x["k"].alias("k"), x["j"].alias("j"), x["lid"].alias("lid"))
    return F.when(takes, new.cast(FOLD)).otherwise(now)


def bin_scores(rows: DataFrame) -> DataFrame:
    """query_id, batch, fid, bin, score, lk, lj, llid, owned: the score of each bin, a fold over its sorted pairs; a row holds one bin."""
    by = [*KEYS, "fid", "bin"]
    # dealt by query batch and recording, as what follows needs them
    pairs = rows.repartition(*KEYS, "fid").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", "j", "lid", "t", "e", "eq"))).alias("pairs"))
    start = F.expr("named_struct('owner', map(), 'score', 0L, 'ordered', 0, 't', 0, 'k', -1, 'j', -1, 'lid', -1)").cast(FOLD)
    done = pairs.select(*by, F.aggregate("pairs", start, _add).alias("x"))
    owned = F.array_sort(F.transform(F.map_entries("x.owner"), lambda o: F.struct(o["key"].alias("lid"), o["value"].alias("k"))))
    return done.select(*by, F.col("x.score").alias("score"), F.col("x.k").alias("lk"), F.col("x.j").alias("lj"), F.col("x.lid").alias("llid"), owned.alias("owned"))


def search(batches: DataFrame, queries: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored pairs (k, lid), bin scores and top candidates of all batches."""
    from tonemark.operators.match import top_candidates

    bins = bin_scores(hits(query_pairs(batches, queries), postings))
    first = F.struct("score", -F.col("lk"), -F.col("lj"), -F.col("llid"))
    best = bins.groupBy(*KEYS, "fid").agg(F.max_by("bin", first).alias("bin"), F.max("score").alias("score"))
    scored = bins.select(*KEYS, "fid", "bin", F.explode("owned").alias("o")).select(*KEYS, "fid", "bin", "o.k", "o.lid")
    return scored, bins.withColumn("last", F.struct("lk", "llid")), top_candidates(best, P.TIES["XSCALE"])
