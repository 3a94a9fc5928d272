"""Signal kernels against plain loops, WAV files, codec, quantisation, evaluation and the command line end to end."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonemark import cli, errors
from tonemark import params as P
from tonemark.functions import audio, codec
from tonemark.operators import codebook, evaluate, quantize, signal
from tonemark.sources import synthetic, wav


def noise(n, seed=1):
    return np.random.default_rng(seed).normal(0, 0.1, n).astype(np.float32)


def test_spectrum_of_a_tone():
    t = np.arange(P.WINDOW) / P.SAMPLE_RATE
    x = signal.energy_frames(np.sin(2 * np.pi * 1000 * t)[None, :])
    assert abs(int(x[0].argmax()) - round(1000 * P.FFT_SIZE / P.SAMPLE_RATE)) <= 1
    assert signal.spectrum(x, "magnitude")[0].max() == pytest.approx(np.sqrt(x.max()), rel=1e-5)


def test_boxes_against_loops():
    x = np.random.default_rng(2).random((12, 15))
    for rt, rf in ((1, 1), (2, 3)):
        for i in range(12):
            for j in range(15):
                part = x[max(0, i - rt) : i + rt + 1, max(0, j - rf) : j + rf + 1]
                assert signal.box_sum(x, rt, rf)[i, j] == pytest.approx(part.sum())
                assert signal.box_max(x, rt, rf)[i, j] == part.max()


def plain_descriptor(x, m, k):
    def energy(t, f):
        return sum(x[u, v] for u in range(t - 1, t + 2) for v in range(f - 3, f + 4) if 0 <= u < x.shape[0] and 0 <= v < x.shape[1])

    codes = []
    for i in range(18):
        for j in range(10):
            t, f = m - 9 + i, P.K_MIN + k - 15 + 3 * j
            c = energy(t, f)
            near = [energy(t + 2, f), energy(t - 2, f), energy(t, f + 6), energy(t, f - 6)]
            gaps = [abs(c - n) for n in near]
            code = 0
            if max(max(c, n) / min(c, n) for n in near) > 2:
                on = [g / max(gaps) > 0.25 for g in gaps]
                code = (on[1] and c > near[1]) * 1 + (on[0] and near[0] > c) * 2 + (on[2] and c > near[2]) * 4 + (on[3] and near[3] > c) * 8
            codes.append(int(code))
    return bytes(codes[i] | codes[i + 1] << 4 for i in range(0, 180, 2))


def test_peaks_and_descriptors_against_loops():
    x = signal.energy_frames(np.lib.stride_tricks.sliding_window_view(noise(12_000), P.WINDOW)[:: P.HOP])
    peaks = signal.find_peaks(x)
    for m, k in ((10, 36), (20, 100), (x.shape[0] - 11, 556)):
        box = x[m - 1 : m + 2, k - 1 : k + 2].astype(float)
        assert peaks[m, k - P.K_MIN] == pytest.approx(box.sum() if 7 * x[m, k] - box.sum() > 0 else 0)
    assert not peaks[:10].any() and not peaks[-10:].any() and not peaks[:, : 36 - P.K_MIN].any() and not peaks[:, 557 - P.K_MIN :].any()
    m, k = signal.points_of_interest(peaks, x)
    assert len(m) > 3
    for a, b in zip(m, k, strict=True):
        assert peaks[a, b] == peaks[max(0, a - 14) : a + 15, max(0, b - 31) : b + 32].max()
    d = signal.descriptors(x, m, k)
    for i in range(3):
        assert d[i].tobytes() == plain_descriptor(x.astype(float), int(m[i]), int(k[i]))


def test_fingerprinter_state():
    f = signal.Fingerprinter()
    assert f.process(noise(int(0.4 * P.SAMPLE_RATE))) == [] and f.frames == 0
    rows = f.process(noise(60_000, 3)) + f.process(noise(60_000, 4))
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    assert all(P.K_MIN <= r[2] <= P.K_MAX and len(r[3]) == P.BYTES for r in rows)
    assert f.frames == (120_000 - P.WINDOW) // P.HOP + 1


def test_fingerprints_by_recording(spark):
    blocks = signal.reblock(synthetic.tones(spark, 3, 7.0), 3.0)
    got = signal.fingerprints(blocks).orderBy("fid", "lid").collect()
    assert {r.fid for r in got} == {1, 2, 3}
    one = next(r for r in blocks.where("fid = 2 and block_no = 0").collect())
    f = signal.Fingerprinter()
    assert [(r.lid, r.t, r.f, bytes(r.d)) for r in got if r.fid == 2 and r.block_no == 0] == f.process(np.array(one.samples, np.float32))


def test_wav_round_trip(spark, tmp_path):
    x = np.clip(noise(5_000), -1, 0.999)
    for bits in (8, 16, 32):
        back = wav.samples(wav.encode(x, 11025, 1, bits))
        assert np.abs(back - x).max() <= 1.01 / 2 ** (bits - 1)
    assert wav.header(b"RIFFxxxx") is None and wav.header(wav.encode(x, 11025)[:20]) is None
    assert len(wav.samples(wav.encode(x, 11025), 100, 50)) == 50
    with pytest.raises(ValueError):
        wav.samples(b"no")
    wav.write(spark.createDataFrame([("sub/a.WAV", x.tolist())], "name string, samples array<float>"), str(tmp_path), 11025)
    (tmp_path / "b.wav").write_bytes(b"junk")
    (tmp_path / "c.txt").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: r for r in wav.read(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.WAV", "b.wav"} and got["b.wav"].samples is None
    assert got["a.WAV"].sample_rate == 11025 and len(got["a.WAV"].samples) == 5_000


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**31 - 1)))
def test_variable_bytes(values):
    assert codec.decode_ints(codec.encode_ints(values)) == values


def test_postings_code():
    rows = [(3, [(0, 5, 200), (4, 5, 10)]), (9, [(1000, 70000, 0)])]
    data = codec.encode_postings(rows)
    assert codec.decode_postings(data) == rows
    assert codec.encode_ints([1, 128]) == bytes([129, 0, 129])
    with pytest.raises(errors.InvalidIndexData):
        codec.decode_ints(data[:-1] + b"\x01")
    with pytest.raises(errors.InvalidIndexData):
        codec.decode_postings(codec.encode_ints([3, 2, 1]))


def test_audio_columns(spark):
    r = spark.createDataFrame([([0.5, -0.5, 0.25], [0.5, 0.5], [16384, -32768], "d/7_3.wav", "T", None)], "a array<double>, b array<double>, i array<int>, p string, t string, s string").select(
        audio.mix(F.col("a"), F.col("b")).alias("mix"),
        audio.mix_channels(F.col("a"), F.col("b"), 1).alias("sum"),
        audio.gain(F.col("a"), 3.0).alias("gain"),
        audio.power(F.col("b")).alias("power"),
        audio.power(F.array().cast("array<double>")).alias("none"),
        audio.normalise(F.col("i")).alias("norm"),
        audio.append(F.col("a"), F.col("b"), 4).alias("joined"),
        audio.duration(F.col("a"), 1, 3).alias("dur"),
        audio.truth_id(F.col("p")).alias("truth"),
        audio.described(F.col("t"), F.col("s"), F.col("p")).alias("title"),
        audio.described(F.col("s"), F.col("s"), F.col("p")).alias("file"),
        audio.supported(F.col("p")).alias("ok"),
        audio.format_time(F.lit(3661)).alias("time"),
        audio.snr(F.lit(100.0), F.lit(1.0)).alias("snr"),
    ).first()
    assert (r.mix, r["sum"], r.gain, r.power, r.none) == ([0.5, 0.0], [1.0, 0.0], [1.0, -1.0, 0.75], 0.25, 0.0)
    assert (r.norm, r.joined, r.dur, r.truth, r.title, r.file, r.ok, r.time, r.snr) == ([0.5, -1.0], [0.5, -0.5, 0.25, 0.5], 1.0, "7", "T", "7_3.wav", True, "01:01:01", 20.0)


def test_quantisation_against_plain_distances(spark):
    rng = np.random.default_rng(5)
    book = rng.integers(0, 256, (7, P.BYTES), dtype=np.uint8)
    book[6] = book[2]
    d = rng.integers(0, 256, (40, P.BYTES), dtype=np.uint8)
    d[0] = book[2]
    got = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(d)], "i int, d binary").select("i", quantize.quantize_udf(book)("d").alias("q"), F.size(quantize.pack_words(F.col("d"))).alias("n")).orderBy("i").collect()
    for r in got:
        dist = [int(np.unpackbits(d[r.i] ^ c).sum()) for c in book]
        assert r.q.e == min(min(dist), 255) and r.q.w == max(i for i, x in enumerate(dist) if x == min(dist)) and r.n == 12
    assert got[0].q.w == 6  # of equal codewords the largest number
    words = spark.createDataFrame([(bytearray(d[1].tobytes()), bytearray(d[2].tobytes()))], "a binary, b binary")
    both = words.select(quantize.hamming_words(quantize.pack_words(F.col("a")), quantize.pack_words(F.col("b")))).first()[0]
    assert both == int(np.unpackbits(d[1] ^ d[2]).sum())


def test_codebook_training_and_records(spark):
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 2, (4, P.BITS))
    bits = np.array([np.where(rng.random(P.BITS) < 0.1, 1 - centres[i % 4], centres[i % 4]) for i in range(120)], dtype=np.uint8)
    lfs = spark.createDataFrame([(1, i, bytearray(np.packbits(b, bitorder="little").tobytes())) for i, b in enumerate(bits)], "fid int, lid int, d binary")
    book = codebook.train(lfs, 4)
    assert book.agg(F.sum("n_points")).first()[0] == 120
    got = {bytes(r.centroid) for r in book.collect()}
    assert len(got & {np.packbits(c.astype(np.uint8), bitorder="little").tobytes() for c in centres}) >= 2  # two seeds may share a centre
    data = codebook.to_bytes(book)
    assert [r[0] for r in codebook.from_bytes(data)] == [0, 1, 2, 3] and len(data) == 4 * 102
    with pytest.raises(errors.InvalidCodebook):
        codebook.from_bytes(data[:-1])


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1), (2, 9), (3, None), (4, None), (5, 5), (5, 6)], "query_id int, fid int")
    truth = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, None), (5, 5)], "query_id int, fid int")
    out = {r.query_id: r.outcome for r in evaluate.outcomes(results, truth).collect()}
    assert out == {1: "TP", 2: "FP", 3: "FN", 4: "TN", 5: "TP"}
    m = evaluate.metrics(evaluate.outcomes(results, truth)).first()
    assert (m.tp, m.fp, m.tn, m.fn, m.precision, m.sensitivity, m.accuracy) == (2, 1, 1, 1, 0.666667, 0.5, 0.6)
    assert evaluate.metrics(evaluate.outcomes(results.limit(0), truth.limit(0))).first().precision is None


def test_command_line_end_to_end(spark, tmp_path, capsys):
    """Index tones from WAV files, then identify a slice of each."""
    recs = synthetic.tones(spark, 4, 24.0).cache()
    name = F.format_string("%03d.wav", "fid")
    wav.write(recs.select(name.alias("name"), "samples"), str(tmp_path / "ref"), P.SAMPLE_RATE)
    cut = F.slice("samples", 5 * P.SAMPLE_RATE, 14 * P.SAMPLE_RATE)
    wav.write(recs.select(name.alias("name"), cut.alias("samples")), str(tmp_path / "clips"), P.SAMPLE_RATE)
    go = lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    go("codebook", tmp_path / "ref", tmp_path / "book", "--words", 40)
    go("index", tmp_path / "ref", tmp_path / "store", tmp_path / "book")
    got = go("identify", tmp_path / "clips", tmp_path / "store", tmp_path / "book", "-s", 0.5).collect()
    found = {r.path.rsplit("/", 1)[1]: r.meta for r in got}
    assert sum(k == v for k, v in found.items()) >= 3, got
    assert cli.main(["analyse", str(tmp_path / "store")], spark) == 0
    go("reindex", tmp_path / "store", tmp_path / "pairs")
    go("commands")
    assert "identify" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.check(cli.parser().parse_args(["identify", "a", "s", "c", "-i", "BINARY", "-d", "EASY"]))


def test_kmedians_on_the_embeddings(spark, sf_dir):
    from tonemark.sources import fixtures

    points = fixtures.descriptors(spark, sf_dir)
    got = quantize.kmedians(points, 5).collect()
    assert sum(r.n_points for r in got) == points.count() and len(got) == 5
    words = [r.word for r in points.select("word").collect()]
    mask = 2**64 - 1
    dist = lambda a, b: bin((a ^ b) & mask).count("1")
    assert sum(r.sum_d for r in got) <= sum(dist(w, words[0]) for w in words)
