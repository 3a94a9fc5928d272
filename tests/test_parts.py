"""Audio formats, sources, live fingerprints, layouts and streams against plain statements."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemark import cli, errors
from tonemark import params as P
from tonemark.functions import codec
from tonemark.operators import evaluate, index, quantize, signal
from tonemark.plans import engine, parts, scratch
from tonemark.sources import id3, synthetic, wav, wav_source
from tonemark.streaming import live, monitor


def tone(n, seed=1):
    rng = np.random.default_rng(seed)
    return np.clip(0.4 * np.sin(np.arange(n) * 0.11) + rng.normal(0, 0.1, n), -1, 0.999)


@pytest.mark.parametrize("bits", wav.BITS)
def test_wav_of_every_resolution(bits):
    x = tone(999)
    data = wav.encode(x, 8000, 1, bits)
    assert wav.header(data)["sample_rate"] == 8000 and len(data) % 2 == 0
    assert np.abs(wav.samples(data) - x).max() <= 1.01 / 2 ** (min(bits, 24) - 1)
    assert wav.samples(wav.encode([0.5, -0.5, 0.25], 8000, 1, bits)).tolist() == [0.5, -0.5, 0.25]


def test_wav_floats_and_other_chunks():
    x = tone(100).astype(np.float32)
    data = wav.encode(x, 8000, 2, 32, floats=True)
    assert (wav.samples(data) == x).all() and len(wav.samples(data, 10, 5)) == 10
    more = data[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + data[12:]
    assert (wav.samples(more) == x).all()
    assert wav.decoded(b"junk") == (None, None, None)
    for bad in ((12, False), (16, True)):
        with pytest.raises(errors.InvalidParameter):
            wav.encode(x, 8000, 1, bad[0], floats=bad[1])


@pytest.mark.parametrize("bits", wav.BITS)
def test_aiff(bits):
    x = tone(501)
    f = io.BytesIO(wav.encode_aiff(x, 11025, 1, bits))
    form, size, kind = struct.unpack(">4sI4s", f.read(12))
    chunks = {}
    while head := f.read(8):
        mark, n = struct.unpack(">4sI", head)
        chunks[mark] = f.read(n + n % 2)[:n]
    channels, frames, width, exponent, mantissa = struct.unpack(">hIhHQ", chunks[b"COMM"])
    assert (form, kind, channels, frames, width) == (b"FORM", b"AIFF", 1, 501, bits) and mantissa >> (63 - (exponent - 16383)) == 11025
    raw = np.frombuffer(chunks[b"SSND"][8:], np.uint8).reshape(501, -1)
    value = sum(raw[:, k].astype(np.int64) << 8 * (bits // 8 - 1 - k) for k in range(bits // 8))
    back = np.where(value >= 1 << bits - 1, value - (1 << bits), value) / 2.0 ** (bits - 1)
    assert np.abs(back - x).max() <= 1.01 / 2 ** (bits - 1)


def read_flac(data):
    """Samples of a FLAC file of verbatim frames, with both sums checked."""
    assert data[:4] == b"fLaC" and data[4] == 0x80
    info = data[8:42]
    word = int.from_bytes(info[10:18], "big")
    rate, channels, bits, total = word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1
    at, out = 42, []
    while at < len(data):
        start = at
        assert data[at : at + 2] == b"\xff\xf8"
        lead = data[at + 4]
        at += 4 + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3)
        n = struct.unpack_from(">H", data, at)[0] + 1
        at += 2
        assert wav._crc(data[start:at], 8, 0x07) == data[at]
        at += 1
        part = []
        for _ in range(channels):
            assert data[at] == 2
            raw = np.frombuffer(data[at + 1 : at + 1 + n * bits // 8], np.uint8).reshape(n, -1)
            value = sum(raw[:, k].astype(np.int64) << 8 * (bits // 8 - 1 - k) for k in range(bits // 8))
            part.append(np.where(value >= 1 << bits - 1, value - (1 << bits), value))
            at += 1 + n * bits // 8
        assert wav._crc(data[start:at], 16, 0x8005) == int.from_bytes(data[at : at + 2], "big")
        at += 2
        out.append(np.stack(part, axis=1))
    x = np.concatenate(out)
    assert len(x) == total
    return rate, x.ravel() / 2.0 ** (bits - 1)


@pytest.mark.parametrize("bits", (8, 16, 24))
def test_flac(bits):
    x = tone(10_001)[:10_000]
    rate, back = read_flac(wav.encode_flac(x, 11025, 2, bits))
    assert rate == 11025 and np.abs(back - x).max() <= 1.01 / 2 ** (bits - 1)
    with pytest.raises(errors.InvalidParameter):
        wav.encode_flac(x, 11025, 1, 32)


def test_resampling_keeps_a_tone():
    t = np.arange(44_100) / 44_100
    got = wav.resample(np.sin(2 * np.pi * 440 * t), 44_100, P.SAMPLE_RATE)
    want = np.sin(2 * np.pi * 440 * np.arange(len(got)) / P.SAMPLE_RATE)
    assert len(got) == P.SAMPLE_RATE and np.abs(got - want)[200:-200].max() < 0.01
    high = wav.resample(np.sin(2 * np.pi * 9_000 * t), 44_100, P.SAMPLE_RATE)  # above what the new rate can hold
    assert np.abs(high[200:-200]).max() < 0.02
    assert (wav.resample(t[:50], 8000, 8000) == t[:50].astype(np.float32)).all()


def test_writing_from_the_tasks_and_refusals(spark, tmp_path):
    rows = spark.createDataFrame([("a/x", tone(500).tolist()), ("y", tone(400, 2).tolist())], "name string, samples array<double>").repartition(2)
    for kind, mark in (("WAV", b"RIFF"), ("AIFF", b"FORM"), ("FLAC", b"fLaC")):
        wav.write(rows, str(tmp_path / kind), 8000, 24, kind)
        assert {p.relative_to(tmp_path / kind).as_posix(): p.read_bytes()[:4] for p in (tmp_path / kind).rglob("*") if p.is_file()} == {"a/x": mark, "y": mark}
    for bits, kind, floats in ((12, "WAV", False), (32, "FLAC", False), (16, "MP3", False), (32, "AIFF", True)):
        with pytest.raises(errors.InvalidParameter):
            wav.write(rows, str(tmp_path), 8000, bits, kind, floats)


def test_id3():
    assert id3.tags(id3.tag_v2("Tïtle", "Artist", "Album") + b"x") == ("Tïtle", "Artist", "Album")
    assert id3.tags(b"x" * 9 + id3.tag_v1("T" * 40, "", "B")) == ("T" * 30, "", "B")
    two = b"TT2" + (6).to_bytes(3, "big") + b"\x00Short"
    assert id3.tags(b"ID3\x02\0\0" + bytes([0, 0, 0, len(two)]) + two) == ("Short", "", "")
    wide = "Wide".encode("utf-16")
    four = b"TPE1" + bytes([0, 0, 0, len(wide) + 1]) + b"\0\0\x01" + wide
    assert id3.tags(b"ID3\x04\0\0" + bytes([0, 0, 0, len(four)]) + four) == ("", "Wide", "")
    assert id3.tags(b"") is None and id3.tags(b"ID3\x03\0\0\0\0\0\x7f") == ("", "", "")


def test_data_source_reads_and_streams(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.wav").write_bytes(wav.encode(tone(100 + i), 22050))
    (tmp_path / "5.wav").write_bytes(b"junk")
    wav_source.register(spark)
    got = {r.path[-5]: r for r in spark.read.format("tonemark_wav").option("rate", 11025).option("files", 2).load(str(tmp_path)).collect()}
    assert len(got) == 6 and got["5"].samples is None and got["3"].sample_rate == 11025 and len(got["3"].samples) == 52
    stream = spark.readStream.format("tonemark_wav").option("files", 2).load(str(tmp_path))
    seen = []
    query = stream.writeStream.foreachBatch(lambda df, b: seen.append(sorted(r.path[-5] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(x for s in seen for x in s) == list("012345") and max(map(len, seen)) <= 2


def test_long_recordings_are_refused(spark):
    recs = spark.createDataFrame([(1, [0.0] * 50), (2, [0.0] * 100), (3, [0.0] * 120)], "fid int, samples array<float>")
    assert [(r.fid, r.seconds) for r in signal.too_long(recs, 10, 10).orderBy("fid").collect()] == [(2, 10.0), (3, 12.0)]
    with pytest.raises(Exception, match="too long"):
        signal.reblock(recs, 1.0, 10, 10).count()
    assert signal.reblock(recs.where("fid = 1"), 1.0, 10, 10).count() == 5


def test_flush_gives_the_incomplete_windows():
    x = tone(12_000).astype(np.float32)
    whole, f = signal.Fingerprinter(), signal.Fingerprinter()
    whole.process(x)
    n = whole.frames
    f.process(x, flush=True)
    assert f.frames == n + -(-len(whole.tail) // P.HOP) and len(f.tail) == 0


def test_sequence_gaps_are_refused(spark):
    q = spark.createDataFrame([(1, 0, i, 4 * i, 100, 5, 60) for i in (0, 1, 3)], "query_id int, block_no int, lid int, t int, f int, w int, e int")
    recs = synthetic.recordings(spark, 1)
    with pytest.raises(errors.InvalidMatchSequence):
        engine.identify(q, index.build(recs), recs)


def plain_layout(lists, chunk_bytes, block_bytes):
    out = []
    for term, postings in lists.items():
        chunk, block, raw, stored, last, fresh = 0, 0, 0, 0, 0, True
        for fid, occ in postings:
            if fresh and (block == 0 or stored >= block_bytes):
                block, stored, last = block + 1, 0, 0
            n = len(codec.encode_postings([(fid, occ)], last))
            out.append((term, fid, len(occ), n, chunk, block))
            stored, last, raw = stored + n, fid, raw + 4 * (2 + 3 * len(occ))
            fresh = raw >= chunk_bytes
            if fresh:
                chunk, raw = chunk + 1, 0
    return sorted(out)


@pytest.mark.parametrize("limits", [(200, 300), (1, 1), (5000, 100), (6553, 32768)])
def test_layout_against_a_walk(spark, limits):
    rng = np.random.default_rng(2)
    rows = []
    for term in range(4):
        for fid in np.sort(rng.choice(40_000, 300, replace=False)):
            for lid in np.sort(rng.choice(3000, int(rng.integers(1, 6)), replace=False)):
                rows.append((term, int(fid) + 1, int(lid), int(lid) * 4, int(rng.integers(50, 255))))
    lists = {}
    for term, fid, lid, t, e in rows:
        lists.setdefault(term, {}).setdefault(fid, []).append((lid, t, e))
    want = plain_layout({k: sorted(v.items()) for k, v in lists.items()}, *limits)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = index.layout(spark.createDataFrame(rows, "term int, fid int, lid int, t int, e int"), *limits)
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_live_fingerprints_equal_the_batch_ones(spark, tmp_path):
    recs = synthetic.tones(spark, 3, 8.0)
    blocks = signal.reblock(recs, 2.0).withColumnRenamed("fid", "query_id")
    for r in blocks.collect():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{r.query_id}_{r.block_no:03d}.wav").write_bytes(wav.encode(r.samples, P.SAMPLE_RATE, 1, 32, floats=True))
    # files of a stream come in order: one at a time
    rows = live.fingerprints(live.chunk_files(spark, str(tmp_path / "in"), 1))
    import os
    import time

    for k, p in enumerate(sorted((tmp_path / "in").iterdir(), key=lambda p: p.name.split("_")[1])):
        os.utime(p, (time.time() - 1000 + k, time.time() - 1000 + k))
    got = []
    stream = rows.writeStream.foreachBatch(lambda df, b: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination()
    want = signal.fingerprints(blocks.withColumnRenamed("query_id", "fid")).collect()
    assert len(want) > 50
    assert sorted((r.query_id, r.block_no, r.lid, r.t, r.f, bytes(r.d)) for r in got) == sorted((r.fid, r.block_no, r.lid, r.t, r.f, bytes(r.d)) for r in want)


def test_silent_streams_end_and_old_state_goes(spark, tmp_path):
    recs = synthetic.recordings(spark, 3, seed=5).cache()
    m = monitor.Monitor(spark, index.build(recs), recs, str(tmp_path / "m"), idle=2)
    first = recs.where("fid = 1 and lid < 10").select(F.lit(7).alias("query_id"), F.lit(0).alias("block_no"), "lid", "t", "f", "w", "e")
    other = lambda n: recs.where("fid = 2").limit(0).select(F.lit(8).alias("query_id"), F.lit(0).alias("block_no"), "lid", "t", "f", "w", "e")
    before = set((p.name for p in (tmp_path.parent).glob("*")))
    for batch, rows in enumerate((first, other(1), other(2), other(3))):
        m(rows, batch)
    assert [(r.query_id, r.status) for r in m.results().collect()] == [(7, "NO_MATCH")]
    assert sorted(p.name for p in (tmp_path / "m" / "state").iterdir() if not p.name.startswith(".")) == ["2", "3"]
    assert before == set((p.name for p in (tmp_path.parent).glob("*")))


def test_scope_removes_its_tables(spark):
    import glob

    base = scratch.shared_dir(spark).removeprefix("file:")
    with scratch.scope(spark):
        scratch.materialize(spark.range(3), "scoped")
        assert glob.glob(f"{base}/scoped-*")
    assert not glob.glob(f"{base}/scoped-*")


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    schema = "ts timestamp, user_id bigint, value double"
    source = str(tmp_path / "in")
    write = lambda *rows: spark.createDataFrame(rows, "ts string, user_id bigint, value double").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value").coalesce(1).write.mode("append").parquet(source)
    write(("2024-01-01 10:05:00", 1, 1.0))
    got = {}

    def keep(df, b):
        for r in df.collect():
            got[(r.user_id, r.w.start.hour)] = r.n

    def go():
        rows = monitor.tumbling(monitor.stored(spark, source, schema), late="10 minutes")
        rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    go()
    write(("2024-01-01 12:30:00", 1, 1.0), ("2024-01-01 10:10:00", 1, 1.0))  # out of order, within the same micro-batch
    go()
    write(("2024-01-01 10:20:00", 1, 1.0), ("2024-01-01 12:40:00", 1, 1.0))  # the first is two hours late
    go()
    assert got == {(1, 10): 2, (1, 12): 2}


def test_seeding(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(-(2**63), 2**63, 4)
    rows = [(i, int(centres[i % 4])) for i in range(400)]
    points = spark.createDataFrame([(i, w, [w >> (63 - b) & 1 for b in range(64)]) for i, w in rows], "point long, word long, bits array<int>")
    assert set(quantize.seeds(points, 4)) == set(map(int, centres))  # equal words have no distance, so each centre comes once
    assert len(quantize.seeds(points, 9, "random")) == 9 and quantize.seeds(points.limit(0), 3) == []
    got = quantize.kmedians(points, 4).collect()
    assert {r.centroid for r in got} == set(map(int, centres)) and sum(r.sum_d for r in got) == 0


def test_noise_mixing(spark):
    clips = spark.createDataFrame([(1, 5, [0.5] * 100), (2, 6, [1.0] * 50)], "query_id int, fid int, samples array<double>")
    noise = spark.createDataFrame([(0, [0.25] * 300)], "fid int, samples array<double>")
    got = {r.query_id: r for r in evaluate.noisy(clips, noise, 1.0, 1.0).collect()}
    assert got[1].samples == [0.375] * 100 and abs(got[1].snr - 10 * np.log10(4)) < 1e-9
    assert evaluate.mean_snr(evaluate.noisy(clips, noise, 1.0, 1.0)).first().clips == 2


def test_performance_and_monitor_commands(spark, tmp_path):
    recs = synthetic.tones(spark, 3, 24.0).cache()
    wav.write(recs.select(F.format_string("%d.wav", "fid").alias("name"), "samples"), str(tmp_path / "ref"), P.SAMPLE_RATE)
    go = lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    go("codebook", tmp_path / "ref", tmp_path / "book", "--words", 30)
    go("index", tmp_path / "ref", tmp_path / "store", tmp_path / "book")
    go("clips", tmp_path / "ref", tmp_path / "clips", "-t", 14)
    assert {p.name for p in (tmp_path / "clips").iterdir()} == {"1_0.wav", "2_0.wav", "3_0.wav"}
    (tmp_path / "noise").mkdir()
    (tmp_path / "noise" / "n.wav").write_bytes(wav.encode(np.random.default_rng(1).normal(0, 0.01, 400_000), P.SAMPLE_RATE))
    r = go("performance", tmp_path / "clips", tmp_path / "noise", tmp_path / "store", tmp_path / "book", "-G", 0.1).first()
    assert r.clips == 3 and r.tp + r.fp + r.tn + r.fn == 3 and r.tp >= 2 and r.snr > 10
    (tmp_path / "in").mkdir()
    cut = signal.reblock(recs.where("fid < 3"), 2.0).collect()
    for r in cut:
        (tmp_path / "in" / f"{r.fid}_{r.block_no:03d}.wav").write_bytes(wav.encode(r.samples, P.SAMPLE_RATE))
    found = go("monitor", tmp_path / "in", tmp_path / "store", tmp_path / "book", tmp_path / "out", "--once").collect()
    assert {r.query_id for r in found} <= {1, 2} and any(r.meta == f"{r.query_id}.wav" for r in found)


def test_parts_have_sql_or_rows(spark, sf_dir):
    from tonemark.plans import oracle

    assert set(parts.QUERIES) <= set(oracle.QUERIES)


def test_tasks_of_a_stream_take_few_rows(spark, sf_dir, monkeypatch):
    from tonemark.plans import parts

    want = sorted(map(tuple, parts.stream_sliding(spark, sf_dir).collect()))
    monkeypatch.setattr(parts, "STREAM_ROWS", 100)
    plan = parts._streamed(spark, sf_dir)._jdf.queryExecution().logical().toString()
    assert "RepartitionByExpression" in plan and plan.split("\n")[0].rstrip().endswith(", 10")
    assert sorted(map(tuple, parts.stream_sliding(spark, sf_dir).collect())) == want


def test_small_files_are_read_once_and_in_few_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"{i}.wav").write_bytes(wav.encode(np.full(i, 0.5), 8000))
    got = wav.spans(spark, str(tmp_path), [(0, None), (100, 50)])
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert got.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < wav.files(spark, str(tmp_path)).rdd.getNumPartitions()
    sizes = {(int(r.path.rsplit("/", 1)[1][:-4]), r.span): len(r.samples) for r in got.collect()}
    assert sizes == {(i, s): n for i in range(400) for s, n in ((0, i), (1, min(50, max(0, i - 100))))}


def test_wav_files_leaves_no_files(spark, sf_dir):
    from pathlib import Path

    from tonemark.plans.scratch import shared_dir

    top = Path(shared_dir(spark).removeprefix("file:"))
    before = set(top.glob("audio-*"))
    assert parts.wav_files(spark, sf_dir).count() == 10 * parts.samples(spark, sf_dir).count()
    assert set(top.glob("audio-*")) == before


def test_layout_is_one_sort_of_bounded_tasks(spark, sf_dir, monkeypatch):
    import duckdb
    from tests.test_catalogue import rows

    from tonemark.plans import oracle

    monkeypatch.setattr(index, "ROWS", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # postings go on from batch to batch
    try:
        got = parts.QUERIES["block_layout_small"](spark, sf_dir)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet'")
        assert rows(got.toPandas()) == rows(con.sql(oracle.sql("block_layout_small")).df())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Aggregate" not in plan
    n = parts.channel_postings(spark, sf_dir).count()
    assert got.rdd.getNumPartitions() == -(-n // 300) > spark.sparkContext.defaultParallelism
