"""Registered queries of single parts: audio blocks and files, signal steps, codes, the store, codebooks, streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemark import params as P
from tonemark.functions import audio, codec
from tonemark.functions import terms as T
from tonemark.operators import codebook, index, quantize, signal
from tonemark.plans.scratch import materialize, remove, shared_dir
from tonemark.sources import fixtures, id3, synthetic, wav, wav_source
from tonemark.sources.store import FingerprintStore, IndexSession, reindex, session
from tonemark.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, samples (array of float, multiples of 1 / 32768): a recording for each supplier, a sample for each of its line items."""
    rows = fixtures.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    value = ((F.col("l_partkey") * 7919 + F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 65536 - 32768) / 32768.0
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", value.cast("float").alias("x"))
    return rows.groupBy((F.col("l_suppkey") + 1).cast("int").alias("fid")).agg(F.transform(F.sort_array(F.collect_list(at)), lambda a: a["x"]).alias("samples"))


def _sum(column: str) -> Column:
    return F.round(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double")), 6)


def audio_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = signal.reblock(samples(spark, sf_dir), 128 / P.SAMPLE_RATE)
    return blocks.select("fid", "block_no", F.size("samples").alias("n"), _sum("samples").alias("total"))


def long_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.too_long(samples(spark, sf_dir), 600, 1).select("fid", "seconds")


def channel_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 1000).cast("int")).alias("i"))
    rows = rows.select("vec_id", audio.normalise(F.col("i"), 11).alias("a"), audio.normalise(F.reverse("i"), 11).alias("b"))
    joined = audio.append(F.col("a"), F.col("b"), 100)
    return rows.select("vec_id", _sum("a").alias("total"), F.round(audio.power(audio.mix_channels(F.col("a"), F.col("b"), 2)), 9).alias("mixed"), F.size(joined).alias("n"), audio.duration(joined, 50, 2).alias("seconds"))


def hamming(spark: SparkSession, _: str) -> DataFrame:
    return spark.createDataFrame([(i, round(float(x), 9)) for i, x in enumerate(signal.hamming_window())], "i int, w double")


def _frames(spark: SparkSession, sf_dir: str, each: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """each: from the energies of a vector, taken as a frame, to rows."""
    rows = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            energy = signal.exact_energy(np.stack(b["embedding"].to_numpy()).astype(np.float64))
            yield pd.DataFrame([(i, *r) for i, e in zip(b["vec_id"], energy, strict=True) for r in each(e)], columns=names)

    return rows.mapInPandas(run, schema)


def energy_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir, lambda e: [(k, round(float(e[k]), 4)) for k in range(0, 1025, 64)], "vec_id bigint, k int, energy double")


def spectrum_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = lambda e: [tuple(round(float(signal.spectrum(e, kind)[::64].sum()), 4) for kind in ("energy", "power", "magnitude"))]
    return _frames(spark, sf_dir, kinds, "vec_id bigint, energy double, power double, magnitude double")


FRAMES, BINS = 40, 640


def _matrices(spark: SparkSession, sf_dir: str, each: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """A made-up spectrum for each region; each: from it to rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        t, f = np.arange(FRAMES, dtype=np.int64)[:, None], np.arange(BINS, dtype=np.int64)[None, :]
        for b in batches:
            rows = []
            for r in b["r_regionkey"]:
                x = (t * t * 31 + f * f * 17 + t * f * 7 + int(r) * 13) % 1009 + 1
                rows += [(int(r), *v) for v in each(x.astype(np.float64))]
            yield pd.DataFrame(rows, columns=names)

    return fixtures.table(spark, sf_dir, "region").select("r_regionkey").mapInPandas(run, schema)


def signal_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def each(x):
        p = signal.find_peaks(x)
        return [(int(a), int(b) + P.K_MIN, float(p[a, b])) for a, b in zip(*np.nonzero(p), strict=True)]

    return _matrices(spark, sf_dir, each, "r bigint, t int, f int, peak double")


def signal_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    def each(x):
        m, k = signal.points_of_interest(signal.find_peaks(x), x)
        return [(int(a), int(b) + P.K_MIN) for a, b in zip(m, k, strict=True)]

    return _matrices(spark, sf_dir, each, "r bigint, t int, f int")


def signal_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def each(x):
        m, k = signal.points_of_interest(signal.find_peaks(x), x)
        d = signal.descriptors(x, m, k)
        return [(int(a), int(b) + P.K_MIN, v.tobytes().hex()) for a, b, v in zip(m, k, d, strict=True)]

    return _matrices(spark, sf_dir, each, "r bigint, t int, f int, d string")


def _written(recordings: DataFrame, bits: int, floats: bool = False) -> str:
    path = folder(recordings.sparkSession, "audio")
    name = F.format_string("a%d/b/%06d.wav", F.col("fid") % 3, "fid")
    wav.write(recordings.select(name.alias("name"), "samples"), path, P.SAMPLE_RATE, bits, floats=floats)
    return path


def _file_number(path: str = "path") -> Column:
    return F.regexp_extract(path, r"(\d+)\.wav$", 1).cast("int")


def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording written and read at every resolution, whole and from a place on. The files of one resolution are there at a time."""
    out = None
    recordings = materialize(samples(spark, sf_dir), "samples")
    wanted = [(0, None), (100, 50)]
    place = F.element_at(F.array(*[F.lit(offset) for offset, _ in wanted]), F.col("span") + 1)
    for bits, floats in ((8, False), (16, False), (24, False), (32, False), (32, True)):
        path = _written(recordings, bits, floats)
        got = wav.spans(spark, path, wanted)
        rows = got.select(_file_number().alias("fid"), F.lit(bits + floats).alias("bits"), place.alias("place"), "sample_rate", "channels", F.size("samples").alias("n"), _sum("samples").alias("total"))
        rows = materialize(rows, "read")
        remove(spark, path)
        out = rows if out is None else out.unionByName(rows)
    return out


def wav_data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    wav_source.register(spark)
    rows = spark.read.format("tonemark_wav").load(_written(samples(spark, sf_dir), 16))
    return rows.select(_file_number().alias("fid"), "sample_rate", F.size("samples").alias("n"), _sum("samples").alias("total"))


def numbered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wav.numbered(wav.files(spark, _written(samples(spark, sf_dir), 8)), 1)
    return found.select(F.regexp_extract("path", r"([^/]+/b/\d+\.wav)$", 1).alias("name"), "fid")


def id3_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of both kinds, written around some audio and read."""
    rows = fixtures.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, *text in zip(b["p_partkey"], b["p_name"], b["p_type"], b["p_brand"], strict=True):
                out.append((f"{k}", [b"xyz" * 50 + id3.tag_v1(*text), id3.tag_v2(*text) + b"xyz" * 50, b"xyz" * 50][k % 3]))
            yield pd.DataFrame(out, columns=["path", "content"])

    tagged = rows.mapInPandas(run, "path string, content binary")
    found = id3.read(tagged)
    return found.select(F.col("path").cast("bigint").alias("p_partkey"), "title", "artist", "album", audio.described(F.col("title"), F.col("artist"), F.concat(F.lit("d/"), "path")).alias("meta"))


def clip_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.clips(samples(spark, sf_dir), 3, 80).select("query_id", "fid", "start", F.size("samples").alias("n"), _sum("samples").alias("total"))


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.transform(F.sort_array(F.collect_list(F.struct("lid", "t"))), lambda x: x["t"].cast("bigint") * 1000)
    return fixtures.corpus(spark, sf_dir).groupBy("fid").agg(at.alias("ts"))


def vbyte_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir).select("fid", F.lower(F.hex(codec.encoded(F.col("ts")))).alias("code"))


def vbyte_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec.register(spark)
    coded = materialize(_times(spark, sf_dir).select("fid", codec.encoded(F.col("ts")).alias("code")), "codes")
    name = f"codes_{uuid.uuid4().hex}"
    coded.createOrReplaceTempView(name)
    return spark.sql(f"SELECT fid, pos, value FROM {name}, LATERAL vbyte_decode(code)")


def channel_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings by channel alone: long lists."""
    return fixtures.corpus(spark, sf_dir).select(T.channel(F.col("f")).alias("term"), "fid", "lid", "t", "e")


def _store(spark: SparkSession, sf_dir: str, where: str = "true", path: str | None = None, mode: str = "BUILD", kind: str = "MSCALE") -> FingerprintStore:
    store = FingerprintStore(spark, path or folder(spark, "store"), mode)
    with session(store, kind) as s:
        s.index(fixtures.corpus(spark, sf_dir).where(where))
    return store


def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of two sessions, the second one's recordings newer: first in a delta, then merged."""
    live = _store(spark, sf_dir, "fid % 1000 < 60 and fid < 1000")
    both = _store(spark, sf_dir, "not (fid % 1000 < 60 and fid < 1000)", live.path, "BUILD_MERGE")
    return both.read("index").groupBy("term").agg(F.count(F.lit(1)).alias("tf"), F.countDistinct("fid").alias("df"), F.max("fid").alias("fid_max"))


def store_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store says of itself, empty, built and cleared."""
    store = FingerprintStore(spark, folder(spark, "store"), "BUILD")
    before = store.is_empty()
    s = IndexSession(store, "XSCALE")
    s.start()
    s.index(fixtures.corpus(spark, sf_dir))
    s.end()
    facts = (before, store.is_empty(), store.fingerprints_count(), store.read("index").count(), s.duplicates, store.match_type())
    store.clear()
    return spark.createDataFrame([(*facts, store.is_empty())], "empty_before boolean, empty boolean, recordings bigint, postings bigint, duplicates bigint, kind string, cleared boolean")


def store_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term's list, and a range of a recording."""
    store = _store(spark, sf_dir)
    term = 3210
    lists = store.postings(term).select(F.lit("list").alias("what"), "fid", F.explode("occ").alias("o")).select("what", "fid", "o.lid", "o.t", "o.e")
    return lists.unionByName(store.fingerprint(7, 50, 31).select(F.lit("range").alias("what"), "fid", "lid", "t", "e"))


def store_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).block_headers()


def store_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = FingerprintStore(spark, folder(spark, "store"), "BUILD")
    store.put_metadata(fixtures.metadata(spark, sf_dir).where("fid % 2 = 0"))
    return store.metadata(fixtures.metadata(spark, sf_dir).select("fid"))


def store_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = FingerprintStore(spark, folder(spark, "store"), "BUILD")
    reindex(_store(spark, sf_dir), target, "XSCALE")
    return target.read("index").groupBy("term").agg(F.count(F.lit(1)).alias("tf"), F.countDistinct("fid").alias("df"))


def _descriptor(key: str) -> Column:
    """A descriptor of P.BYTES bytes."""
    return F.unhex(F.substring(F.repeat(F.md5(F.col(key).cast("string")), 6), 1, 2 * P.BYTES))


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fixtures.table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("int").alias("word")).agg(F.count(F.lit(1)).alias("n_points"), F.sum("vec_id").cast("double").alias("sum_d"))
    return labels.select("word", "sum_d", "n_points", _descriptor("word").alias("centroid"))


def codebook_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r[0], float(r[1]), r[2], r[3].hex()) for r in codebook.from_bytes(codebook.to_bytes(_book(spark, sf_dir)))]
    return spark.createDataFrame(rows, "word int, sum_d double, n_points bigint, centroid string")


def quantize_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of 720 bits against a codebook, by the Arrow function, and their distance from word 0 by columns."""
    book = sorted(_book(spark, sf_dir).select("word", "centroid").collect(), key=lambda r: r["word"])
    table = np.array([list(bytes(r["centroid"])) for r in book], dtype=np.uint8)
    rows = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("key"))
    rows = rows.withColumn("d", _descriptor("key")).withColumn("q", quantize.quantize_udf(table)("d"))
    first = quantize.pack_words(F.lit(bytes(book[0]["centroid"])))
    return rows.select("vec_id", "q.w", "q.e", quantize.hamming_words(quantize.pack_words(F.col("d")), first).cast("int").alias("from_first"))


def kmedians_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quantize.kmedians(fixtures.descriptors(spark, sf_dir), 5, rounds=2, tolerance=-1.0, seeding="random")
    return got.select("code", F.lpad(F.conv(F.col("centroid").cast("string"), 10, 2), 64, "0").alias("bits"), "sum_d", "n_points")


def seed_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixtures.descriptors(spark, sf_dir)
    chosen = quantize.seeds(points, 3, "random")
    return quantize.least_distances(points, chosen).select("point", F.col("d").cast("int").alias("d"))


def term_limits(spark: SparkSession, _: str) -> DataFrame:
    return spark.createDataFrame([(k, T.max_term(k)) for k in P.MATCH_TYPES], "kind string, max_term int")


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "part")
    number = F.regexp_extract("p_brand", r"(\d+)", 1)
    return rows.select("p_partkey", F.col("p_size").cast("string").alias("text"), F.try_to_number(number, F.lit("999")).cast("int").alias("number"), F.round(F.log2("p_size"), 9).alias("log2"))


#: Rows of a stream that a task takes at once; in windows that overlap each counts several times.
STREAM_ROWS = 250_000


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files, all in one micro-batch. However many there are, a task gets some STREAM_ROWS rows."""
    path = folder(spark, "events")
    rows = fixtures.table(spark, sf_dir, "events").select("ts", "user_id", "value")
    n = max(4, -(-rows.count() // STREAM_ROWS))
    rows.repartition(n).write.parquet(path)
    return monitor.stored(spark, path, "ts timestamp, user_id bigint, value double", n).repartition(n, "user_id", "ts")


def _windows(rows: DataFrame, name: str) -> DataFrame:
    got = monitor.drained(rows, name)
    return got.select("user_id", F.unix_timestamp("w.start").alias("start_s"), "n", F.round("total", 4).alias("total"))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _windows(monitor.tumbling(_streamed(spark, sf_dir)), "tumbling")
    return got.select("user_id", F.floor(F.col("start_s") / 3600).alias("hour"), "n", "total")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(monitor.sliding(_streamed(spark, sf_dir)), "sliding")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = monitor.drained(monitor.sessions(_streamed(spark, sf_dir)), "sessions")
    return got.select("user_id", "n", F.unix_timestamp("first").alias("start_s"), F.unix_timestamp("last").alias("last_s"))


QUERIES: dict[str, Query] = {
    "audio_blocks": audio_blocks,
    "long_recordings": long_recordings,
    "channel_mix": channel_mix,
    "hamming_window": hamming,
    "energy_frames": energy_frames,
    "spectrum_kinds": spectrum_kinds,
    "signal_peaks": signal_peaks,
    "signal_points": signal_points,
    "signal_descriptors": signal_descriptors,
    "wav_files": wav_files,
    "wav_data_source": wav_data_source,
    "numbered_files": numbered_files,
    "id3_tags": id3_tags,
    "clip_cuts": clip_cuts,
    "vbyte_code": vbyte_code,
    "vbyte_table_function": vbyte_table_function,
    "block_layout": lambda spark, d: index.layout(channel_postings(spark, d)),
    "block_layout_small": lambda spark, d: index.layout(channel_postings(spark, d), 500, 900),
    "block_headers": lambda spark, d: index.block_headers(index.layout(channel_postings(spark, d), 500, 900)),
    "delta_merge": store_merge,
    "store_facts": store_facts,
    "store_lists": store_lists,
    "store_headers": store_headers,
    "store_metadata": store_metadata,
    "store_reindex": store_reindex,
    "codebook_records": codebook_records,
    "quantize_whole": quantize_whole,
    "kmedians_rounds": kmedians_rounds,
    "seed_distances": seed_distances,
    "term_limits": term_limits,
    "conversions": conversions,
    "stream_tumbling": stream_tumbling,
    "stream_sliding": stream_sliding,
    "session_windows": session_windows,
}
