"""Command line: spark-submit tonemark/cli.py COMMAND ..., or python -m tonemark.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemark import params as P
from tonemark.errors import InvalidCodebook
from tonemark.functions import audio
from tonemark.operators import evaluate, quantize, signal
from tonemark.plans import engine
from tonemark.plans.scratch import materialize
from tonemark.sources import synthetic, wav
from tonemark.sources.store import FingerprintStore, reindex, session
from tonemark.streaming import live, monitor


def load_codebook(spark: SparkSession, path: str) -> np.ndarray:
    """codebook table (word, centroid): as many rows as words, each of P.BYTES bytes."""
    rows = sorted(spark.read.parquet(path).select("word", "centroid").limit(P.WORDS + 1).collect(), key=lambda r: r["word"])
    if not rows or len(rows) > P.WORDS or any(len(r["centroid"]) != P.BYTES for r in rows):
        raise InvalidCodebook(f"a codebook has 1 to {P.WORDS} codewords of {P.BYTES} bytes")
    return np.array([list(bytes(r["centroid"])) for r in rows], dtype=np.uint8)


def quantised_fingerprints(blocks: DataFrame, codebook: np.ndarray) -> DataFrame:
    """fid, block_no, lid, t, f, w, e of audio blocks."""
    rows = signal.fingerprints(blocks).withColumn("q", quantize.quantize_udf(codebook)("d"))
    return rows.select("fid", "block_no", "lid", "t", "f", F.col("q.w").alias("w"), F.col("q.e").alias("e"))


def recordings(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """fid, path, samples of the audio files below a folder, numbered by path and converted to the engine's sample rate. Says which can't be read."""
    rows = wav.read(spark, path, rate=P.SAMPLE_RATE)
    found = materialize(rows, "audio").join(wav.numbered(wav.files(spark, path), first), "path")
    lost = found.where(F.col("samples").isNull()).select("path")
    n = lost.count()
    if n:
        print(f"{n} files can't be read:", *[r["path"] for r in lost.orderBy("path").limit(20).collect()], sep="\n", file=sys.stderr)
    return found.where(F.col("samples").isNotNull())


def short_enough(recs: DataFrame, most: float) -> DataFrame:
    """Without the recordings that are too long, which are named."""
    bad = signal.too_long(recs, most)
    rows = bad.orderBy("fid").limit(20).collect()
    if rows:
        print(*[r["error"] for r in rows], sep="\n", file=sys.stderr)
    return recs.join(bad.select("fid"), "fid", "left_anti")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tonemark")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *args: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for a in args:
            c.add_argument(a)
        return c

    add("codebook", "train a codebook from the WAV files of a folder", "audio", "codebook").add_argument("--words", type=int, default=P.WORDS)
    c = add("index", "index the WAV files of a folder", "audio", "store", "codebook")
    c.add_argument("-m", "--match-type", choices=P.MATCH_TYPES, default="MSCALE")
    c.add_argument("-l", "--max-seconds", type=float, default=float(P.MAX_RECORDING))
    c = add("monitor", "identify live audio: files <stream>_<number>.wav that arrive in a folder", "audio", "store", "codebook", "out")
    c.add_argument("-o", "--once", action="store_true", help="stop when all files are read")
    c.add_argument("-f", "--files", type=int, default=16, help="files of a micro-batch")
    c.add_argument("-w", "--wait", type=int, default=0, help="micro-batches without data after which a stream ends")
    c = add("clips", "cut clips out of the audio files of a folder", "audio", "out")
    c.add_argument("-n", type=int, default=1, help="clips of a file")
    c.add_argument("-t", "--seconds", type=float, default=15.0)
    c = add("performance", "accuracy of identification of clips mixed with noise", "audio", "noise", "store", "codebook")
    c.add_argument("-g", "--gain", type=float, default=1.0)
    c.add_argument("-G", "--noise-gain", type=float, default=0.5)
    c = add("reindex", "build an index from a store's fingerprints", "store", "target")
    c.add_argument("-m", "--match-type", choices=P.MATCH_TYPES, default="XSCALE")
    c = add("identify", "identify the WAV files of a folder", "audio", "store", "codebook")
    c.add_argument("-i", "--id-type", choices=P.ID_TYPES, default="FUZZY")
    c.add_argument("-d", "--id-mode", choices=P.ID_MODES)
    c.add_argument("-b", "--threshold", type=float)
    c.add_argument("-s", "--rerank", type=float, default=1.0)
    c = add("synthesise", "write a store of random recordings", "store")
    c.add_argument("-n", type=int, default=100)
    add("analyse", "distribution of fingerprints per second in a store", "store")
    add("commands", "list the commands")
    return p


def check(args: argparse.Namespace) -> None:
    if args.command == "identify":
        if args.id_mode and args.id_type != "FUZZY":
            raise SystemExit("-d goes with FUZZY only")
        if args.threshold is not None and args.id_type != "BINARY":
            raise SystemExit("-b goes with BINARY only")


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    if args.command == "codebook":
        from tonemark.operators.codebook import train

        blocks = signal.reblock(recordings(spark, args.audio), P.INDEX_SECONDS)
        train(signal.fingerprints(blocks), args.words).write.mode("overwrite").parquet(args.codebook)
    elif args.command == "index":
        store = FingerprintStore(spark, args.store, "BUILD")
        old = store.read("fingerprints").agg(F.max("fid")).first()[0] or 0
        most = engine.Config(max_recording=args.max_seconds).max_recording
        recs = short_enough(recordings(spark, args.audio, old + 1), most)
        qlf = materialize(quantised_fingerprints(signal.reblock(recs, P.INDEX_SECONDS, most), load_codebook(spark, args.codebook)).drop("block_no"), "fingerprints")
        with session(store, args.match_type) as s:
            s.index(qlf)
        store.put_metadata(recs.select("fid", F.regexp_extract("path", r"([^/]+)$", 1).alias("meta")))
    elif args.command == "reindex":
        reindex(FingerprintStore(spark, args.store), FingerprintStore(spark, args.target, "BUILD"), args.match_type)
    elif args.command == "identify":
        store = FingerprintStore(spark, args.store)
        config = engine.Config(match_type=store.match_type() or "MSCALE", id_type=args.id_type, id_mode=args.id_mode or "EASY", binary_threshold=0.7 if args.threshold is None else args.threshold, rerank_threshold=args.rerank)
        clips = recordings(spark, args.audio)
        q = quantised_fingerprints(signal.reblock(clips, config.step_seconds), load_codebook(spark, args.codebook)).withColumnRenamed("fid", "query_id")
        got = engine.identify(q, store.read("index"), store.read("fingerprints"), config)
        return engine.with_metadata(got, store.read("metadata")).join(clips.select(F.col("fid").alias("query_id"), "path"), "query_id")
    elif args.command == "monitor":
        store = FingerprintStore(spark, args.store)
        config = engine.Config(match_type=store.match_type() or "MSCALE")
        chunks = live.fingerprints(live.chunk_files(spark, args.audio, args.files), codebook=load_codebook(spark, args.codebook))
        target = monitor.Monitor(spark, store.read("index"), store.read("fingerprints"), args.out, config, idle=args.wait)
        stream = monitor.start(chunks, target, f"{args.out}/checkpoint", **({"availableNow": True} if args.once else {}))
        stream.awaitTermination()
        return engine.with_metadata(target.results(), store.read("metadata"))
    elif args.command == "clips":
        recs = recordings(spark, args.audio)
        cut = synthetic.clips(recs, args.n, int(args.seconds * P.SAMPLE_RATE)).join(recs.select("fid", "path"), "fid")
        stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
        wav.write(cut.select(F.concat(stem, F.lit("_"), (F.col("query_id") % args.n).cast("string"), F.lit(".wav")).alias("name"), "samples"), args.out, P.SAMPLE_RATE)
    elif args.command == "performance":
        return performance(spark, args)
    elif args.command == "synthesise":
        store = FingerprintStore(spark, args.store, "BUILD")
        with session(store) as s:
            s.index(synthetic.recordings(spark, args.n))
    elif args.command == "analyse":
        rows = FingerprintStore(spark, args.store).read("fingerprints")
        return evaluate.rate_histogram(rows.groupBy("fid", F.floor(F.col("t") / 73).alias("s")).agg(F.count(F.lit(1)).alias("n"))).orderBy("n")
    elif args.command == "commands":
        print(*next(a for a in parser()._actions if a.dest == "command").choices, sep="\n")
    return None


def performance(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """clips, snr, tp, fp, tn, fn, precision, sensitivity, accuracy. A clip's recording is told by its file's name, see truth_id()."""
    store = FingerprintStore(spark, args.store)
    clips = recordings(spark, args.audio)
    meta = store.read("metadata").select(audio.truth_id(F.col("meta")).alias("truth"), F.col("fid").alias("of"))
    known = clips.withColumn("truth", audio.truth_id(F.col("path"))).join(meta, "truth", "left")
    mixed = materialize(evaluate.noisy(known.select(F.col("fid").alias("query_id"), F.col("of").alias("fid"), "samples"), recordings(spark, args.noise), args.gain, args.noise_gain), "noisy")
    config = engine.Config(match_type=store.match_type() or "MSCALE")
    blocks = signal.reblock(mixed.select(F.col("query_id").alias("fid"), "samples"), config.step_seconds)
    q = materialize(quantised_fingerprints(blocks, load_codebook(spark, args.codebook)).withColumnRenamed("fid", "query_id"), "queries")
    found = engine.identify(q, store.read("index"), store.read("fingerprints"), config)
    level = evaluate.mean_snr(mixed).first()
    return evaluate.metrics(evaluate.outcomes(found, mixed.select("query_id", "fid"))).withColumns({"clips": F.lit(level["clips"]), "snr": F.lit(level["snr"])})


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    check(args)
    out = run(spark or SparkSession.builder.appName("tonemark").getOrCreate(), args)
    if out is not None:
        out.show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
