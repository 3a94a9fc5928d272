"""The engine: parameters with their checks, and identification of many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark import params as P
from tonemark.errors import InvalidMatchSequence, InvalidParameter
from tonemark.operators import decide, local_graphs, match, rerank, xscale
from tonemark.plans.scratch import materialize


@dataclass
class Config:
    """How queries are matched and decided. step_seconds: length of a step of identification."""

    match_type: str = "MSCALE"
    rerank_threshold: float = 0.5
    id_type: str = "FUZZY"
    id_mode: str = "EASY"
    binary_threshold: float = 0.9
    binary_min_time: float = 0.0
    max_recording: float = P.MAX_RECORDING
    step_seconds: float = 1.804088

    def __post_init__(self):
        self.check()

    def check(self) -> None:
        def need(good: bool, what: str) -> None:
            if not good:
                raise InvalidParameter(what)

        need(self.match_type in P.MATCH_TYPES, f"match type {self.match_type}")
        need(self.id_type in P.ID_TYPES, f"identification type {self.id_type}")
        need(self.id_mode in P.ID_MODES, f"identification mode {self.id_mode}")
        need(0 <= self.rerank_threshold <= 1, "the re-rank threshold is from 0 to 1")
        need(0.5 <= self.binary_threshold <= 1, "the binary threshold is from 0.5 to 1")
        need(0 <= self.binary_min_time <= P.MAX_ID_TIME, "the binary minimum time is from 0 to 20")
        need(self.max_recording > 0, "the maximum recording duration is positive")
        need(0 < self.step_seconds <= P.QUERY_SECONDS, "a step is at most 2.5 seconds")


def check_sequence(queries: DataFrame) -> None:
    """Fingerprints of a query are numbered from 0 without gaps."""
    bad = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lid").alias("d"), F.min("lid").alias("a"), F.max("lid").alias("b"))
    row = bad.where("n <> d or a <> 0 or b <> n - 1").first()
    if row is not None:
        raise InvalidMatchSequence(f"query {row['query_id']}: fingerprint numbers must be 0, 1, 2, ...")


def contributions(batches: DataFrame, queries: DataFrame, postings: DataFrame, recordings: DataFrame, config: Config) -> DataFrame:
    """query_id, batch, fid, score, bin: what each batch adds. Batches of low confidence go through the graphs, the others count as they are."""
    by_pairs = config.match_type == "XSCALE"
    if by_pairs:
        scored, bins, top = xscale.search(batches, queries, postings)
    else:
        top = match.leading(batches, postings)
    top = materialize(top, "top")
    conf = match.confidences(top)
    unclear = conf.where(F.col("conf") <= config.rerank_threshold).select(*match.KEYS)
    clear = top.join(unclear, match.KEYS, "left_anti").select(*match.KEYS, "fid", "score", "bin")
    doubtful = top.join(unclear, match.KEYS, "left_semi")
    if by_pairs:
        pairs = materialize(rerank.centre_pairs(scored, match.peaks(bins, doubtful)), "pairs")
        again = rerank.rerank(rerank.common_edges(pairs, batches, queries, recordings))
    else:
        again = local_graphs.search(doubtful, batches, queries, postings, recordings, "again")
    return clear.unionByName(again).select(*match.KEYS, "fid", F.col("score").cast("bigint").alias("score"), F.col("bin").cast("int").alias("bin"))


def flush_batches(queries: DataFrame, at: DataFrame) -> DataFrame:
    """The rest that no whole batch has, as received at a step (query_id, block_no): at least two fingerprints."""
    got = queries.join(at.select("query_id", F.col("block_no").alias("done_block")), "query_id").where(F.col("block_no") <= F.col("done_block"))
    ends = got.groupBy("query_id").agg((F.max("lid")).alias("horizon"))
    rest = got.join(ends, "query_id").withColumn("batch", F.floor(F.col("lid") / P.BATCH).cast("int"))
    rest = rest.where(F.col("batch") == F.floor((F.col("horizon") + 1) / P.BATCH))
    enough = rest.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("query_id")
    return rest.join(enough, "query_id", "left_semi")


def identify(queries: DataFrame, postings: DataFrame, recordings: DataFrame, config: Config | None = None, flush: bool = True) -> DataFrame:
    """One row for each match of a query, or one that says NO_MATCH or PENDING.

    queries: query_id, block_no, lid, t, f, w, e. postings: term, fid, lid, t, e of the configured match type. recordings:
    fid, lid, t, f, w, e. With flush a query that would end without a match has its incomplete last batch tried first.
    Raises InvalidMatchSequence if fingerprints of a query are not numbered 0, 1, 2, ...
    """
    config = config or Config()
    check_sequence(queries)
    batches = materialize(match.full_batches(queries), "batches")
    parts = materialize(contributions(batches, queries, postings, recordings, config), "parts")
    dur = config.step_seconds
    step = decide.steps(queries, batches, dur)
    best = decide.best_of_steps(step, decide.final_top(decide.accumulated(parts, batches)))
    if config.id_type == "BINARY":
        decided = materialize(decide.binary_decisions(step, best, config.binary_threshold, config.binary_min_time), "decided")
    else:
        decided = materialize(decide.first_decisions(decide.fuzzy_steps(step, best, dur, config.id_mode)), "decided")
    if flush:
        decided = _flushed(decided, queries, batches, parts, postings, recordings, config, best)
    return decide.results(decided, queries)


def _flushed(decided: DataFrame, queries: DataFrame, batches: DataFrame, parts: DataFrame, postings: DataFrame, recordings: DataFrame, config: Config, best: DataFrame) -> DataFrame:
    lost = decided.groupBy("query_id").agg(F.max("block_no").alias("block_no"), F.max("id_time").alias("id_time"), F.max((F.col("class") != "UNIDENTIFIED").cast("int")).alias("won")).where("won = 0").drop("won")
    lost = materialize(lost, "lost")
    rest = materialize(flush_batches(queries, lost), "flush")
    more = contributions(rest, queries, postings, recordings, config)
    known = parts.join(batches.select("query_id", "batch", "done_block").distinct(), match.KEYS).join(lost.select("query_id", "block_no"), "query_id").where(F.col("done_block") <= F.col("block_no"))
    both = more.unionByName(known.select(more.columns))
    last = rest.select("query_id", "batch").distinct()
    top = decide.final_top(decide.accumulated(both, last))
    step = lost.join(last, "query_id").select("query_id", "block_no", "batch", "id_time")
    now = decide.best_of_steps(step, top)
    # the time of the flush: from the last whole batch's end to the last fingerprint
    ends = rest.groupBy("query_id").agg(F.max("t").alias("t1"), F.min("lid").alias("lid"))
    starts = queries.select("query_id", (F.col("lid") + 1).alias("lid"), F.col("t").alias("t0"))
    spans = ends.join(starts, ["query_id", "lid"], "left").select("query_id", ((F.col("t1") - F.coalesce("t0", F.lit(0))) * P.DT).alias("span"))
    earlier = best.join(lost.select("query_id", F.col("block_no").alias("end")), "query_id").where(F.col("block_no") <= F.col("end")).groupBy("query_id", "fid").agg(F.sum("conf").alias("c"), F.count(F.lit(1)).alias("n"))
    rows = now.join(earlier, ["query_id", "fid"], "left").join(spans, "query_id").withColumn("mean_conf", (F.coalesce("c", F.lit(0.0)) + F.col("conf")) / (F.coalesce("n", F.lit(0)) + 1)).withColumn("acc_time", F.coalesce("n", F.lit(0)) * F.lit(config.step_seconds) + F.col("span"))
    if config.id_type == "BINARY":
        hit = F.when((F.col("conf") >= config.binary_threshold) & (F.col("id_time") >= config.binary_min_time), "IDENTIFIED").otherwise("UNIDENTIFIED")
        rows = rows.withColumn("class", hit).withColumn("mean_conf", F.col("conf"))
    else:
        time = F.when(F.col("id_time") < P.MAX_ID_TIME, F.col("acc_time")).otherwise(F.col("id_time"))
        rows = rows.withColumn("class", decide.classify(F.col("mean_conf"), time, config.id_mode))
    won = materialize(rows.where(F.col("class").isin("IDENTIFIED", "SOUNDS_LIKE")).select([c for c in decided.columns if c in rows.columns]), "won")
    return decided.join(won.select("query_id").distinct(), "query_id", "left_anti").unionByName(won, allowMissingColumns=True)


def with_metadata(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds meta; empty where there is none."""
    return results.join(metadata, "fid", "left").withColumn("meta", F.coalesce("meta", F.lit("")))


def as_json(results: DataFrame) -> DataFrame:
    """query_id, json: status and matches of each query, in order of fid."""
    one = F.struct(F.col("fid").alias("FID"), F.col("score").alias("Score"), F.col("confidence").alias("Confidence"), F.col("id_class").alias("IdClass"), F.col("meta").alias("Metadata"))
    got = results.groupBy("query_id").agg(F.max("status").alias("status"), F.sort_array(F.collect_list(F.when(F.col("fid").isNotNull(), one))).alias("Matches"))
    return got.select("query_id", F.to_json(F.struct("status", "Matches")).alias("json"))
