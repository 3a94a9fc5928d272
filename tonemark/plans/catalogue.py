"""The registered queries: each operator applied to whole test tables by way of the fixtures."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonemark import params as P
from tonemark.functions import audio, codec
from tonemark.functions import terms as T
from tonemark.operators import decide, evaluate, grid, index, local_graphs, match, quantize, signal, xscale
from tonemark.plans import engine, parts
from tonemark.plans.scratch import materialize
from tonemark.sources import fixtures, synthetic

Query = Callable[[SparkSession, str], DataFrame]
DUR = engine.Config().step_seconds


class Stages:
    """Intermediate tables of identification over the fixtures, each planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = False):
        """keep: write recordings, queries, candidates and their hits to tables, for queries that read them several times."""
        self.spark, self.sf_dir, self.keep = spark, sf_dir, keep

    @cached_property
    def qlf(self) -> DataFrame:
        rows = fixtures.corpus(self.spark, self.sf_dir)
        return materialize(rows, "recordings") if self.keep else rows

    @cached_property
    def q(self) -> DataFrame:
        rows = fixtures.query_fingerprints(self.spark, self.sf_dir)
        return materialize(rows, "queries") if self.keep else rows

    @cached_property
    def postings(self) -> DataFrame:
        return index.single_terms(self.qlf)

    @cached_property
    def batches(self) -> DataFrame:
        return match.full_batches(self.q)

    def found(self, mode: str) -> DataFrame:
        return grid.search(match.query_terms(self.batches), self.postings, mode)

    @cached_property
    def top(self) -> DataFrame:
        rows = match.leading(self.batches, self.postings)
        return materialize(rows, "top") if self.keep else rows

    @cached_property
    def doubtful(self) -> DataFrame:
        unclear = match.confidences(self.top).where(F.col("conf") <= 0.5).select(*match.KEYS)
        return self.top.join(unclear, match.KEYS, "left_semi")

    def graphs(self, mode: str) -> DataFrame:
        return local_graphs.search(self.doubtful, self.batches, self.q, self.postings, self.qlf, mode)

    @cached_property
    def parts(self) -> DataFrame:
        return materialize(engine.contributions(self.batches, self.q, self.postings, self.qlf, engine.Config()), "parts")

    @cached_property
    def acc(self) -> DataFrame:
        return decide.accumulated(self.parts, self.batches)

    @cached_property
    def step_best(self) -> DataFrame:
        return decide.best_of_steps(decide.steps(self.q, self.batches, DUR), decide.final_top(self.acc))

    def identified(self, flush: bool = False, **config) -> DataFrame:
        return engine.identify(self.q, self.postings, self.qlf, engine.Config(**config), flush=flush)

    @cached_property
    def truth(self) -> DataFrame:
        return self.q.select("query_id").distinct().withColumn("fid", F.when(F.col("query_id") < 1_000_000, F.col("query_id")))


def _listed(occ: str) -> Column:
    return F.array_join(F.transform(occ, lambda o: F.concat_ws(":", o["lid"].cast("string"), o["t"].cast("string"), o["e"].cast("string"))), " ")


def _grid(spark: SparkSession, mode: str) -> DataFrame:
    rows = spark.range(51 * 51).select((F.floor(F.col("id") / 51) / 50).alias("c"), (F.col("id") % 51 / 2).alias("d"))
    return rows.withColumn("class", decide.classify(F.col("c"), F.col("d"), mode))


def _majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.bit_majority(fixtures.descriptors(spark, sf_dir), "label").select(F.col("label").alias("code"), "centroid")


def _hamming_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _majority(spark, sf_dir)
    others = F.explode(F.array(*[F.struct(F.lit(i).alias("b"), F.lit(c).cast("bigint").alias("c")) for i, c in quantize.codewords(m)])).alias("o")
    return m.select(F.col("code").alias("a"), "centroid", others).select("a", "o.b", quantize.hamming(F.col("centroid"), F.col("o.c")).cast("int").alias("dist"))


def _bits(word: Column) -> Column:
    return F.lpad(F.conv(word.cast("string"), 10, 2), 64, "0")


def _codebook_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _majority(spark, sf_dir)
    return quantize.duplicate_codewords(m.unionByName(m.where("code < 3")))


def _delta(qlf: DataFrame) -> DataFrame:
    w = Window.partitionBy("fid").orderBy("lid")
    return qlf.select("fid", "lid", (F.col("lid") - F.lag("lid", 1, 0).over(w)).alias("dlid"), (F.col("t") - F.lag("t", 1, 0).over(w)).alias("dt"))


def _undelta(qlf: DataFrame) -> DataFrame:
    w = Window.partitionBy("fid").orderBy("lid").rowsBetween(Window.unboundedPreceding, 0)
    return _delta(qlf).select("fid", F.sum("dlid").over(w).cast("int").alias("lid"), F.sum("dt").over(w).cast("int").alias("t"))


def _vbyte(s: Stages) -> DataFrame:
    rows = s.qlf.groupBy("fid").agg(F.transform(F.sort_array(F.collect_list(F.struct("lid", "t"))), lambda x: x["t"].cast("bigint")).alias("ts"))
    coded = rows.withColumn("code", codec.encoded(F.col("ts")))
    return coded.select("fid", F.size("ts").alias("n"), F.length("code").alias("n_bytes"), (codec.decoded(F.col("code")) == F.col("ts")).alias("same"))


def _audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a")).withColumn("z", F.reverse("a"))


def _mix_gain_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, z = F.col("a"), F.col("z")
    return _audio(spark, sf_dir).select("vec_id", F.round(audio.power(audio.mix(a, z)), 9).alias("mix_power"), F.round(audio.power(audio.gain(a, 4.0)), 9).alias("gain_power"), F.round(audio.power(a), 9).alias("power"))


def _snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _audio(spark, sf_dir).select("label", (audio.power(audio.sub_block(F.col("a"), 0, 32)) * 32).alias("s"), (audio.power(audio.sub_block(F.col("a"), 32, 32)) * 32).alias("n"))
    return rows.groupBy("label").agg(F.round(audio.snr(F.sum("s"), F.sum("n")), 6).alias("snr"))


def _format_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "orders").select("o_orderkey", audio.format_time(F.col("o_totalprice")).alias("hms"))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("wav", "Mp3", "txt", "flac"))), (F.col("page_id") % 4 + 1).cast("int"))
    return fixtures.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("clips/"), F.col("page_id").cast("string"), F.lit("_1."), kind).alias("path"))


def _stft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.fingerprints(signal.reblock(synthetic.tones(spark, 8), 6.0))


def _kmedians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.kmedians(fixtures.descriptors(spark, sf_dir), 10)


def _xscale(s: Stages, flush: bool = False) -> DataFrame:
    return engine.identify(s.q, index.build(s.qlf, "XSCALE"), s.qlf, engine.Config(match_type="XSCALE"), flush=flush)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tonemark.streaming import monitor

    s = Stages(spark, sf_dir)
    return monitor.run_once(s.q, s.postings, s.qlf)


def _s(f: Callable[[Stages], DataFrame], keep: bool = False) -> Query:
    return lambda spark, sf_dir: f(Stages(spark, sf_dir, keep))


QUERIES: dict[str, Query] = {
    "qlf_corpus": _s(lambda s: s.qlf),
    "query_fingerprints": _s(lambda s: s.q),
    "terms_single": _s(lambda s: s.postings),
    "term_channel_hist": _s(lambda s: s.qlf.groupBy(T.channel(F.col("f")).alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fid").alias("recordings"))),
    "postings_single": _s(lambda s: index.postings(s.postings).select("term", "fid", "tf", _listed("occ").alias("occ"))),
    "postings_stats": _s(lambda s: s.postings.groupBy("term").agg(F.countDistinct("fid").alias("df"), F.count(F.lit(1)).alias("cf"))),
    "biterms": _s(lambda s: index.pair_terms(s.qlf)),
    "biterm_dedup": _s(lambda s: index.pair_terms(s.qlf).agg(F.count(F.lit(1)).alias("n_pairs")).crossJoin(index.distinct_pair_terms(s.qlf).agg(F.count(F.lit(1)).alias("n_distinct"))).withColumn("n_duplicates", F.col("n_pairs") - F.col("n_distinct"))),
    "postings_bi": _s(lambda s: index.postings(index.build(s.qlf, "XSCALE")).select("term", "fid", "tf", _listed("occ").alias("occ"))),
    "query_batches": _s(lambda s: s.batches.select("query_id", "batch", "lid", "block_no", "done_block", "horizon")),
    "query_term_dedup": _s(lambda s: match.query_terms(s.batches)),
    "candidates_join": _s(lambda s: s.found("hits")),
    "bin_first_hit": _s(lambda s: s.found("firsts")),
    "time_order_scores": _s(lambda s: s.found("scored")),
    "bin_scores": _s(lambda s: s.found("bins")),
    "best_bin": _s(lambda s: s.found("best")),
    "topk_candidates": _s(lambda s: s.top),
    "batch_confidence": _s(lambda s: match.confidences(s.top).withColumn("conf", F.round("conf", 6))),
    "peak_bins": _s(lambda s: s.graphs("peaks"), keep=True),
    "graph_edges": _s(lambda s: local_graphs.query_edges(s.graphs("centres"), s.batches, s.q), keep=True),
    "graph_common": _s(lambda s: s.graphs("common"), keep=True),
    "graph_rerank": _s(lambda s: s.graphs("again"), keep=True),
    "accumulate": _s(lambda s: s.acc, keep=True),
    "final_topk": _s(lambda s: decide.final_top(s.acc).drop("bin"), keep=True),
    "step_confidence": _s(lambda s: s.step_best.select("query_id", "block_no", "fid", "ac", F.round("conf", 6).alias("conf")), keep=True),
    "running_confidence": _s(lambda s: decide.running(s.step_best, DUR).select("query_id", "block_no", "fid", F.round("mean_conf", 6).alias("mean_conf"), F.round("acc_time", 6).alias("acc_time")), keep=True),
    "fuzzy_easy": lambda spark, _: _grid(spark, "EASY"),
    "fuzzy_strict": lambda spark, _: _grid(spark, "STRICT"),
    "fuzzy_identify": _s(lambda s: s.identified(), keep=True),
    "fuzzy_identify_all": _s(lambda s: engine.identify(materialize(fixtures.all_query_fingerprints(s.spark, s.sf_dir), "queries"), s.postings, s.qlf, engine.Config(), flush=False), keep=True),
    "fuzzy_identify_flush": _s(lambda s: s.identified(flush=True), keep=True),
    "binary_identify": _s(lambda s: s.identified(id_type="BINARY", binary_threshold=0.7), keep=True),
    "cue_points": _s(lambda s: s.found("best").select(*match.KEYS, "fid", T.cue_point(F.col("bin")).alias("cue_point"))),
    "results_with_metadata": _s(lambda s: engine.with_metadata(s.identified(), fixtures.metadata(s.spark, s.sf_dir)).select("query_id", "status", "fid", "meta"), keep=True),
    "results_json": _s(lambda s: engine.as_json(engine.with_metadata(s.identified(), fixtures.metadata(s.spark, s.sf_dir))), keep=True),
    "xscale_match": _s(_xscale, keep=True),
    "xscale_bins": _s(lambda s: xscale.search(s.batches, s.q, index.build(s.qlf, "XSCALE"))[2], keep=True),
    "hamming_matrix": _hamming_matrix,
    "quantize": lambda spark, d: quantize.nearest_word(fixtures.descriptors(spark, d).select("point", "word"), _majority(spark, d), 64).select("point", "code", "dist"),
    "bit_majority": lambda spark, d: _majority(spark, d).select(F.col("code").alias("label"), _bits(F.col("centroid")).alias("bits")),
    "codebook_dupes": _codebook_dupes,
    "kmedians": _kmedians,
    "delta_encode": _s(lambda s: _delta(s.qlf)),
    "delta_decode": _s(lambda s: _undelta(s.qlf)),
    "vbyte_roundtrip": _s(_vbyte),
    "index_invariants": _s(lambda s: index.invariants(s.qlf)),
    "fid_monotonic": _s(lambda s: s.qlf.groupBy("fid").agg(F.count(F.lit(1)).alias("n"), F.min("lid").alias("first_lid"), F.max("lid").alias("last_lid")).withColumn("good", (F.col("n") == F.col("last_lid") + 1) & (F.col("first_lid") == 0))),
    "ranged_fingerprint": _s(lambda s: s.qlf.where((F.col("fid") == 7) & F.col("lid").between(50, 80))),
    "eval_metrics": _s(lambda s: evaluate.metrics(evaluate.outcomes(s.identified(), s.truth)), keep=True),
    "eval_semi": _s(lambda s: s.identified().where("fid is not null").select("query_id", "fid").join(s.truth, ["query_id", "fid"], "left_semi"), keep=True),
    "eval_anti": _s(lambda s: s.identified().where("fid is not null").select("query_id", "fid").join(s.truth, ["query_id", "fid"], "left_anti"), keep=True),
    "lf_rate_hist": _s(lambda s: evaluate.rate_histogram(s.qlf.groupBy("fid", F.floor(F.col("t") / 73).alias("s")).agg(F.count(F.lit(1)).alias("n")))),
    "mix_gain_power": _mix_gain_power,
    "snr": _snr,
    "format_time": _format_time,
    "supported_formats": lambda spark, d: _clips(spark, d).select("page_id", audio.supported(F.col("path")).alias("supported")),
    "clip_truth": lambda spark, d: _clips(spark, d).select("page_id", audio.truth_id(F.col("path")).alias("truth")),
    "stft_fingerprint": _stft,
    "synthetic_corpus": lambda spark, _: synthetic.recordings(spark, 20),
    "stream_identify": _stream,
    **parts.QUERIES,
}
