"""From samples to local fingerprints: spectrum, peaks, points of interest, binary descriptors. numpy over Arrow batches.

Work is dealt by recording: each recording's blocks arrive in order and only one block and its overlap are held. As peaks
are sought within a block, fingerprints depend on the block length, which is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark import params as P


def hamming_window(n: int = P.WINDOW) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def exact_energy(frames: np.ndarray) -> np.ndarray:
    """Energy spectrum of each frame, zero-padded to FFT_SIZE; the first and last bin have a real part only."""
    z = np.fft.rfft(frames * hamming_window(frames.shape[1]), P.FFT_SIZE, axis=1)
    return z.real**2 + z.imag**2


def energy_frames(frames: np.ndarray) -> np.ndarray:
    """exact_energy in 32 bits, as the later steps take it."""
    return exact_energy(frames).astype(np.float32)


def spectrum(energy: np.ndarray, kind: str) -> np.ndarray:
    """energy, power (by the number of bins) or magnitude."""
    return {"energy": energy, "power": energy / energy.shape[-1], "magnitude": np.sqrt(energy)}[kind]


def box_sum(x: np.ndarray, rt: int, rf: int) -> np.ndarray:
    """Sum over a box around each cell; cells outside count 0. By an integral image."""
    s = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    s[1:, 1:] = x.cumsum(axis=0).cumsum(axis=1)
    i, j = np.arange(x.shape[0])[:, None], np.arange(x.shape[1])[None, :]
    a, b = np.clip(i - rt, 0, None), np.clip(i + rt + 1, None, x.shape[0])
    c, d = np.clip(j - rf, 0, None), np.clip(j + rf + 1, None, x.shape[1])
    return s[b, d] - s[a, d] - s[b, c] + s[a, c]


def box_max(x: np.ndarray, rt: int, rf: int) -> np.ndarray:
    """Maximum over a box around each cell."""
    for axis, r in ((0, rt), (1, rf)):
        pad = [(r, r) if k == axis else (0, 0) for k in range(2)]
        x = np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, constant_values=-np.inf), 2 * r + 1, axis=axis).max(axis=-1)
    return x


def find_peaks(x: np.ndarray) -> np.ndarray:
    """(frames, bins in use): the sum of the 3x3 box where seven times its centre exceeds it, away from the block's edges; else 0."""
    out = np.zeros((x.shape[0], P.K_MAX - P.K_MIN + 1))
    lo, hi = P.AROUND_T, x.shape[0] - P.AROUND_T
    a, b = P.K_MIN + P.AROUND_F, P.K_MAX - P.AROUND_F
    if hi > lo:
        near = box_sum(x.astype(np.float64), 1, 1)[lo:hi, a:b]
        out[lo:hi, a - P.K_MIN : b - P.K_MIN] = np.where(7 * x[lo:hi, a:b].astype(np.float64) - near > 0, near, 0)
    return out


def points_of_interest(peaks: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins (from 0) of peaks that no larger one suppresses; ties all stay. A cell whose energy is exactly 0 is lost."""
    top = (peaks > 0) & (peaks >= box_max(peaks, P.SUPPRESS_T, P.SUPPRESS_F))
    return np.nonzero(top & (x[:, : peaks.shape[1]] > 0))


def descriptors(x: np.ndarray, m: np.ndarray, k: np.ndarray) -> np.ndarray:
    """(points, BYTES): four bits for each of the windows around a point, by the energies of its four neighbours."""
    if not len(m):
        return np.zeros((0, P.BYTES), dtype=np.uint8)
    rt, rf = P.CELL_T, P.CELL_F
    pad_t, pad_f = P.AROUND_T + 3 * rt + P.NEXT_T + 2, P.AROUND_F + 3 * rf + P.NEXT_F + 2
    e = box_sum(np.pad(x.astype(np.float64), ((pad_t, pad_t), (pad_f, pad_f))), rt, rf)
    t = (m - P.AROUND_T + rt)[:, None, None] + np.arange(P.CELLS_T)[None, :, None] * P.STRIDE_T + pad_t
    f = (P.K_MIN + k - P.AROUND_F + rf)[:, None, None] + np.arange(P.CELLS_F)[None, None, :] * P.STRIDE_F + pad_f
    c = e[t, f]
    east, west = e[t + P.NEXT_T + rt, f], e[t - P.NEXT_T - rt, f]
    north, south = e[t, f + P.NEXT_F + rf], e[t, f - P.NEXT_F - rf]
    four = np.stack([east, west, north, south])
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nanmax(np.maximum(c, four) / np.minimum(c, four), axis=0, initial=0)
        gap = np.abs(c - four)
        far = gap / gap.max(axis=0) > 0.25
    on = ratio > 2
    code = (far[1] & (c > west)) * 1 + (far[0] & (east > c)) * 2 + (far[2] & (c > north)) * 4 + (far[3] & (south > c)) * 8
    code = np.where(on, code, 0).reshape(len(m), -1).astype(np.uint8)
    return code[:, 0::2] | code[:, 1::2] << 4


@dataclass
class Fingerprinter:
    """Local fingerprints of a stream of blocks: the overlap, the frame and the number reached are its state."""

    tail: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    frames: int = 0
    count: int = 0

    def process(self, samples: np.ndarray, flush: bool = False) -> list[tuple[int, int, int, bytes]]:
        """(lid, t, f, d) of a block; one of less than LEAST_BLOCK seconds is dropped and leaves the state alone. flush: the last block, whose rest gives incomplete windows that end in zeros."""
        if len(samples) < P.LEAST_BLOCK * P.SAMPLE_RATE:
            return []
        data = np.concatenate([self.tail, samples.astype(np.float32)])
        n = max(0, (len(data) - P.WINDOW) // P.HOP + 1)
        self.tail = data[n * P.HOP :]
        if flush and len(self.tail):
            more = -(-len(self.tail) // P.HOP)
            data = np.concatenate([data, np.zeros(P.WINDOW, dtype=np.float32)])[: (n + more - 1) * P.HOP + P.WINDOW]
            n, self.tail = n + more, self.tail[:0]
        if n < 3:
            self.frames += n
            return []
        x = energy_frames(np.lib.stride_tricks.sliding_window_view(data, P.WINDOW)[: (n - 1) * P.HOP + 1 : P.HOP])
        m, k = points_of_interest(find_peaks(x), x)
        d = descriptors(x, m, k)
        out = [(self.count + i, self.frames + int(a), P.K_MIN + int(b), d[i].tobytes()) for i, (a, b) in enumerate(zip(m, k, strict=True))]
        self.frames += n
        self.count += len(out)
        return out


def fingerprints(blocks: DataFrame) -> DataFrame:
    """fid, block_no, lid, t, f, d of audio blocks (fid, block_no, samples array<float>)."""
    schema = "fid int, block_no int, lid int, t int, f int, d binary"
    out = pa.schema([("fid", pa.int32()), ("block_no", pa.int32()), ("lid", pa.int32()), ("t", pa.int32()), ("f", pa.int32()), ("d", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Fingerprinter()
        for b in batches:
            rows = []
            for fid, no, samples in zip(b["fid"].to_pylist(), b["block_no"].to_pylist(), b["samples"], strict=True):
                if fid != now:
                    now, state = fid, Fingerprinter()
                rows += [(fid, no, *r) for r in state.process(samples.values.to_numpy(zero_copy_only=False))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return blocks.select("fid", "block_no", "samples").repartition("fid").sortWithinPartitions("fid", "block_no").mapInArrow(run, schema)


def too_long(samples: DataFrame, most: float = P.MAX_RECORDING, rate: int = P.SAMPLE_RATE) -> DataFrame:
    """fid, seconds, error of the recordings that are refused: those of `most` seconds or more."""
    seconds = F.size("samples") / rate
    text = F.format_string("recording %d has %.1f seconds, %.0f or more are not allowed", "fid", seconds, F.lit(float(most)))
    return samples.select("fid", seconds.alias("seconds"), text.alias("error")).where(F.col("seconds") >= most)


def reblock(samples: DataFrame, seconds: float, most: float = P.MAX_RECORDING, rate: int = P.SAMPLE_RATE) -> DataFrame:
    """Audio blocks of equal length from samples (fid, samples): block_no counts them. A recording of `most` seconds or more is an error, see too_long()."""
    n = round(seconds * rate)
    size = F.size("samples")
    rows = samples.where(F.when(size < most * rate, True).otherwise(F.raise_error(F.format_string("recording %d is too long", "fid")).cast("boolean")))
    parts = F.greatest(F.ceil(size / n), F.lit(1)).cast("int")
    out = rows.select("fid", "samples", F.posexplode(F.sequence(F.lit(0), parts - 1)).alias("block_no", "i"))
    return out.select("fid", "block_no", F.slice("samples", F.col("i") * n + 1, F.lit(n)).alias("samples"))
