"""Graph re-ranking: candidates of unclear batches are scored by the edges that their neighbourhoods share with the query's.

An edge joins two fingerprints of a neighbourhood; its key is their distance in quantised time and frequency and the
distance of the first to the neighbourhood's centre. Edges of query and recording meet in one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemark import params as P
from tonemark.functions import terms as T
from tonemark.operators.match import KEYS

PAIR = [*KEYS, "fid", "bin", "k", "lid"]


def centre_pairs(scored: DataFrame, peak: DataFrame) -> DataFrame:
    """query_id, batch, fid, bin, k, lid: the scored hits in peak bins."""
    return scored.join(peak.select(*KEYS, "fid", "bin"), [*KEYS, "fid", "bin"], "left_semi").select(*PAIR)


def _edges(rows: DataFrame, by: list[str]) -> DataFrame:
    """Edges of neighbourhoods: rows has by, centre (t, f) as ct, cf and a member lid, t, f, w, e. Of equal keys the last edge counts."""
    a = rows.select(*by, "ct", "cf", F.struct("lid", "t", "f", "w", "e").alias("i"))
    b = rows.select(*by, F.struct("lid", "t", "f", "w", "e").alias("j"))
    both = a.join(b, by).where(F.col("i.lid") < F.col("j.lid"))
    q = lambda x, unit: T.quantised(F.col(x), unit)
    key: Column = T.edge_hash(q("j.t", 5) - q("i.t", 5), q("j.f", 9) - q("i.f", 9), q("ct", 5) - q("i.t", 5), q("cf", 9) - q("i.f", 9))
    return both.withColumn("edge", key).groupBy(*by, "edge").agg(F.max(F.struct(F.col("i.lid").alias("il"), F.col("j.lid").alias("jl"), "i", "j")).alias("x")).select(*by, "edge", F.col("x.i").alias("i"), F.col("x.j").alias("j"))


def query_edges(pairs: DataFrame, batches: DataFrame, queries: DataFrame) -> DataFrame:
    """Edges around each query fingerprint k of a pair: AROUND_GRAPH before and after it, as far as received (horizon)."""
    centre = pairs.select(*KEYS, "k").distinct().join(batches.select(*KEYS, F.col("lid").alias("k"), F.col("t").alias("ct"), F.col("f").alias("cf"), "horizon"), [*KEYS, "k"])
    near = (F.col("lid") >= F.col("k") - P.AROUND_GRAPH) & (F.col("lid") <= F.least(F.col("k") + P.AROUND_GRAPH, F.col("horizon")))
    rows = centre.join(queries.select("query_id", "lid", "t", "f", "w", "e"), "query_id").where(near)
    return _edges(rows, [*KEYS, "k"])


def _offsets(rows: DataFrame) -> DataFrame:
    """Adds o: where a member stands from the centre, in quantised time and frequency, eight bits each.

    An edge's key says the same as the offsets of its two ends, so neighbourhoods can be compared by their members.
    """
    low = lambda x: x.bitwiseAND(F.lit(255))
    q = lambda x, unit: T.quantised(F.col(x), unit)
    return rows.withColumn("o", (low(q("ct", 5) - q("t", 5)) * 256 + low(q("cf", 9) - q("f", 9))).cast("int"))


def common_members(pairs: DataFrame, batches: DataFrame, queries: DataFrame, recordings: DataFrame) -> DataFrame:
    """The columns of pairs, o, q, r: members of the query's and the recording's neighbourhood with equal offsets."""
    ends = batches.select(*KEYS, F.col("lid").alias("k"), F.col("t").alias("ct"), F.col("f").alias("cf"), "horizon")
    whole = pairs.join(ends, [*KEYS, "k"]).withColumns({"left": F.least(F.col("k"), F.lit(P.AROUND_GRAPH)), "right": F.least(F.lit(P.AROUND_GRAPH), F.col("horizon") - F.col("k"))})
    member = F.struct("lid", "t", "f", "w", "e")
    # each query fingerprint's neighbourhood once, as far as received; likewise each recording fingerprint's
    places = F.explode(F.sequence(-F.col("left"), F.col("right"))).alias("p")
    near = whole.select(*KEYS, "k", "ct", "cf", "left", "right").distinct().select(*KEYS, "k", "ct", "cf", places)
    near = near.withColumn("lid", F.col("k") + F.col("p")).join(queries.select("query_id", "lid", "t", "f", "w", "e"), ["query_id", "lid"])
    qn = _offsets(near).select(*KEYS, "k", "o", member.alias("q"))
    rec = recordings.select("fid", "lid", "t", "f", "w", "e")
    spans = whole.select("fid", F.col("lid").alias("centre"), "left", "right").distinct()
    middle = spans.join(rec.select("fid", F.col("lid").alias("centre"), F.col("t").alias("ct"), F.col("f").alias("cf")), ["fid", "centre"])
    around = middle.select("fid", "centre", "left", "right", "ct", "cf", places).withColumn("lid", F.col("centre") + F.col("p")).join(rec, ["fid", "lid"])
    rn = _offsets(around).select("fid", F.col("centre").alias("lid"), "left", "right", "o", member.alias("r"))
    return whole.drop("ct", "cf", "horizon").join(qn, [*KEYS, "k"]).join(rn, ["fid", "lid", "left", "right", "o"]).select(*PAIR, "o", "q", "r")


def common_edges(pairs: DataFrame, batches: DataFrame, queries: DataFrame, recordings: DataFrame) -> DataFrame:
    """query_id, batch, fid, bin, k, lid, edge, score, bin1, bin2: edges that both neighbourhoods of a pair have.

    An edge's ends are common members, so only these are joined with each other: a few instead of all pairs of a
    neighbourhood. Of edges with equal keys the last one counts on either side.
    """
    # dealt by query batch and recording once, for all that follows up to the recording's score
    both = common_members(pairs, batches, queries, recordings).repartition(*KEYS, "fid")
    side = lambda x: F.sort_array(F.collect_set(F.struct(f"{x}.lid", "o", f"{x}.t", f"{x}.w", f"{x}.e")))
    members = both.groupBy(*PAIR).agg(side("q").alias("qs"), side("r").alias("rs")).where((F.size("qs") > 1) & (F.size("rs") > 1))

    def edges(of: str) -> Column:
        """Edges among the members of a side (at most 31), each from a smaller to a larger number."""
        after = lambda x: F.filter(of, lambda y: y["lid"] > x["lid"])
        return F.flatten(F.transform(of, lambda x: F.transform(after(x), lambda y: F.struct((x["o"].cast("bigint") * 65536 + y["o"]).alias("key"), x.alias("i"), y.alias("j")))))

    def last(found: str) -> Column:
        later = lambda e, g: (g["key"] == e["key"]) & ((g["i"]["lid"] > e["i"]["lid"]) | ((g["i"]["lid"] == e["i"]["lid"]) & (g["j"]["lid"] > e["j"]["lid"])))
        return F.filter(found, lambda e: ~F.exists(found, lambda g: later(e, g)))

    rows = members.select(*PAIR, edges("qs").alias("qe"), edges("rs").alias("re")).select(*PAIR, last("qe").alias("qe"), last("re").alias("re"))
    met = F.flatten(F.transform("qe", lambda a: F.transform(F.filter("re", lambda b: b["key"] == a["key"]), lambda b: F.struct(a.alias("qs"), b.alias("rs")))))
    met = rows.select(*PAIR, F.explode(met).alias("m")).select(*PAIR, "m.qs", "m.rs", F.col("m.qs.i.o").alias("oi"), F.col("m.qs.j.o").alias("oj"))
    same = lambda x: F.when(F.col(f"qs.{x}.w") == F.col(f"rs.{x}.w"), T.similarity(F.col(f"qs.{x}.e"), F.col(f"rs.{x}.e"))).otherwise(0)
    score = (1000 + same("i") + same("j")).cast("bigint")
    part = lambda o, k: F.floor(F.col(o) / 256) if k == 0 else F.col(o) % 256
    key = T.edge_hash(part("oi", 0) - part("oj", 0), part("oi", 1) - part("oj", 1), part("oi", 0), part("oi", 1))
    return met.select(*PAIR, key.alias("edge"), score.alias("score"), T.time_bin(F.col("rs.i.t")).alias("bin1"), T.time_bin(F.col("rs.j.t")).alias("bin2"))


def graph_scores(edges: DataFrame) -> DataFrame:
    """query_id, batch, fid, peak, bin, score: half of each edge's score to the bin of either end."""
    ends = edges.select(*KEYS, "fid", F.col("bin").alias("peak"), F.floor(F.col("score") / 2).alias("half"), F.explode(F.array("bin1", "bin2")).alias("bin"))
    return ends.groupBy(*KEYS, "fid", "peak", "bin").agg(F.sum("half").cast("bigint").alias("score"))


def rerank(edges: DataFrame) -> DataFrame:
    """query_id, batch, fid, score, bin: the sum over peaks of their best bin's score, and the best bin of all."""
    best = graph_scores(edges).groupBy(*KEYS, "fid", "peak").agg(F.max(F.struct("score", (-F.col("bin")).alias("b"))).alias("x"))
    out = best.groupBy(*KEYS, "fid").agg(F.sum("x.score").cast("bigint").alias("score"), F.max(F.struct("x.score", (-F.col("peak")).alias("p"), "x.b")).alias("y"))
    return out.select(*KEYS, "fid", "score", (-F.col("y.b")).cast("int").alias("bin"))
