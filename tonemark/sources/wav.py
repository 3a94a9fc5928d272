"""Audio files: reading whole folders of WAV, and writing WAV, AIFF and FLAC.

PCM of 8 to 32 bits and 32-bit float are read, other sample rates are converted on request. Files are read and written by the
tasks; nothing passes through the driver.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemark.errors import InvalidParameter
from tonemark.functions.audio import supported

HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
BITS = (8, 16, 24, 32)
FORMATS = ("WAV", "AIFF", "FLAC")
#: Partitions of a folder's files that a task reads, and bytes. Spark counts 4 MB for opening a file, so that a partition is some 32 small ones.
PARTITIONS, TASK_BYTES = 32, 64 << 20


def header(data: bytes) -> dict | None:
    """Fields of the fmt and data chunks, and where the samples start; None unless it is PCM or float with consistent rates."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(data):
        mark, size = struct.unpack_from("<4sI", data, at)
        at += 8
        if mark == b"fmt " and size >= 16 and at + 16 <= len(data):
            fmt = struct.unpack_from("<HHIIHH", data, at)
        elif mark == b"data":
            if fmt is None:
                return None
            kind, channels, rate, byte_rate, align, bits = fmt
            good = (kind == 1 and bits in BITS) or (kind == 3 and bits == 32)
            if not good or not channels or align != channels * bits // 8 or byte_rate != rate * align:
                return None
            return {"channels": channels, "sample_rate": rate, "bits": bits, "float": kind == 3, "n_bytes": size, "start": at}
        at += size + size % 2
    return None


def samples(data: bytes, offset: int = 0, count: int | None = None) -> np.ndarray:
    """Samples in [-1, 1), interleaved; offset and count are in frames."""
    h = header(data)
    if h is None:
        raise ValueError("not a PCM or float WAV file")
    wide = h["bits"] // 8
    step = wide * h["channels"]
    body = data[h["start"] : h["start"] + h["n_bytes"]]
    body = body[offset * step : None if count is None else (offset + count) * step]
    body = body[: len(body) // step * step]
    if h["float"]:
        return np.frombuffer(body, "<f4").copy()
    if wide == 1:
        return (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
    if wide == 3:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        raw = raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24
        return (raw / 2.0**31).astype(np.float32)
    return (np.frombuffer(body, "<i2" if wide == 2 else "<i4") / 2.0 ** (h["bits"] - 1)).astype(np.float32)


def _integers(values: np.ndarray, bits: int) -> np.ndarray:
    top = 2.0 ** (bits - 1)
    return np.clip(np.round(np.asarray(values, dtype=np.float64) * top), -top, top - 1).astype(np.int64)


def _packed(x: np.ndarray, bits: int, big: bool) -> bytes:
    order = ">" if big else "<"
    if bits == 24:
        raw = x.astype(f"{order}i4").view(np.uint8).reshape(-1, 4)
        return raw[:, 1:].tobytes() if big else raw[:, :3].tobytes()
    return x.astype(f"{order}i{bits // 8}").tobytes()


def encode(values: np.ndarray, rate: int, channels: int = 1, bits: int = 16, floats: bool = False) -> bytes:
    """Samples in [-1, 1) as a WAV file of 8, 16, 24 or 32 bits, or of 32-bit floats."""
    if bits not in BITS or (floats and bits != 32):
        raise InvalidParameter(f"{bits} bits")
    if floats:
        body = np.asarray(values, dtype="<f4").tobytes()
    else:
        x = _integers(values, bits)
        body = (x + 128).astype(np.uint8).tobytes() if bits == 8 else _packed(x, bits, False)
    align = channels * bits // 8
    pad = b"\0" * (len(body) % 2)
    return HEADER.pack(b"RIFF", 36 + len(body) + len(pad), b"WAVE", b"fmt ", 16, 3 if floats else 1, channels, rate, rate * align, align, bits, b"data", len(body)) + body + pad


def encode_aiff(values: np.ndarray, rate: int, channels: int = 1, bits: int = 16) -> bytes:
    """Samples in [-1, 1) as an AIFF file."""
    if bits not in BITS:
        raise InvalidParameter(f"{bits} bits")
    x = _integers(values, bits)
    body = _packed(x, bits, True)
    exponent = rate.bit_length() - 1  # the rate as an 80-bit float
    number = struct.pack(">HQ", 16383 + exponent, rate << (63 - exponent))
    common = struct.pack(">hIh", channels, len(x) // channels, bits) + number
    sound = struct.pack(">II", 0, 0) + body
    parts = b"".join(m + struct.pack(">I", len(p)) + p + b"\0" * (len(p) % 2) for m, p in ((b"COMM", common), (b"SSND", sound)))
    return b"FORM" + struct.pack(">I", 4 + len(parts)) + b"AIFF" + parts


def _crc(data: bytes, bits: int, polynomial: int) -> int:
    table = []
    for i in range(256):
        r = i << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ polynomial if r >> (bits - 1) & 1 else r << 1) & (1 << bits) - 1
        table.append(r)
    crc = 0
    for b in data:
        crc = (crc << 8 ^ table[crc >> (bits - 8) ^ b]) & (1 << bits) - 1
    return crc


def encode_flac(values: np.ndarray, rate: int, channels: int = 1, bits: int = 16, block: int = 4096) -> bytes:
    """Samples in [-1, 1) as a FLAC file of 8, 16 or 24 bits whose frames hold the samples as they are."""
    if bits not in (8, 16, 24):
        raise InvalidParameter(f"{bits} bits")
    x = _integers(values, bits).reshape(-1, channels)
    raw = _packed(x.ravel(), bits, False)
    info = struct.pack(">HH", block, block) + b"\0" * 6 + (rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    out = [b"fLaC", b"\x80" + len(info).to_bytes(3, "big"), info]
    for k in range(-(-len(x) // block)):
        part = x[k * block : (k + 1) * block]
        # sync, fixed blocks; size in 16 bits at the end, rate as in the header; channels, bits as in the header
        head = b"\xff\xf8" + bytes([0x70, (channels - 1) << 4]) + chr(k).encode("utf-8", "surrogatepass") + struct.pack(">H", len(part) - 1)
        head += bytes([_crc(head, 8, 0x07)])
        body = b"".join(b"\x02" + _packed(part[:, c], bits, True) for c in range(channels))  # verbatim
        out.append(head + body + _crc(head + body, 16, 0x8005).to_bytes(2, "big"))
    return b"".join(out)


def resample(x: np.ndarray, rate: int, wanted: int, half: int = 16) -> np.ndarray:
    """Samples at another rate, by a windowed sinc of `half` zero crossings a side at the lower of the two rates."""
    if rate == wanted or not len(x):
        return np.asarray(x, dtype=np.float32)
    g = gcd(rate, wanted)
    n = -(-len(x) * (wanted // g) // (rate // g))
    cut = min(1.0, wanted / rate)
    reach = int(np.ceil(half / cut))
    padded = np.concatenate([np.zeros(reach), np.asarray(x, dtype=np.float64), np.zeros(reach + 1)])
    out = np.empty(n, dtype=np.float32)
    steps = np.arange(-reach, reach + 1)
    for a in range(0, n, 16_384):
        at = np.arange(a, min(n, a + 16_384)) * rate / wanted
        base = np.floor(at).astype(np.int64)
        d = (base[:, None] + steps) - at[:, None]
        w = cut * np.sinc(cut * d) * np.where(np.abs(d) <= reach, 0.5 + 0.5 * np.cos(np.pi * d / (reach + 1)), 0)
        out[a : a + len(at)] = (padded[np.minimum(base[:, None] + steps + reach, len(padded) - 1)] * w).sum(axis=1)
    return out


def decoded(data: bytes, offset: int = 0, count: int | None = None, rate: int | None = None) -> tuple[int | None, int | None, np.ndarray | None]:
    """Sample rate, channels and samples of one channel, the mean of all; nothing if the file can't be read."""
    h = header(data)
    if h is None:
        return None, None, None
    x = samples(data, offset, count).reshape(-1, h["channels"]).mean(axis=1).astype(np.float32)
    return (rate or h["sample_rate"]), h["channels"], (resample(x, h["sample_rate"], rate) if rate else x)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The audio files below a folder, by extension. Only what is selected is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.where(supported(F.col("path")))


def _dealt(found: DataFrame) -> DataFrame:
    """The same files in tasks of PARTITIONS partitions and TASK_BYTES at most, but enough tasks for all cores."""
    plan = found._jdf.queryExecution()
    parts, size = plan.toRdd().getNumPartitions(), int(str(plan.optimizedPlan().stats().sizeInBytes()))
    return found.coalesce(max(2 * found.sparkSession.sparkContext.defaultParallelism, -(-parts // PARTITIONS), -(-size // TASK_BYTES)))


def spans(spark: SparkSession, path: str, wanted: list[tuple[int, int | None]], rate: int | None = None) -> DataFrame:
    """Like read, with a row for each (offset, count) that is wanted, whose number is span. A file is opened once for all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, *decoded(bytes(data), offset, count, rate)) for p, data in zip(b["path"], b["content"], strict=True) for i, (offset, count) in enumerate(wanted)]
            yield pd.DataFrame(rows, columns=["path", "span", "sample_rate", "channels", "samples"])

    return _dealt(files(spark, path)).select("path", "content").mapInPandas(run, "path string, span int, sample_rate int, channels int, samples array<float>")


def read(spark: SparkSession, path: str, offset: int = 0, count: int | None = None, rate: int | None = None) -> DataFrame:
    """path, sample_rate, channels, samples of the files below a folder; those that can't be decoded have null fields. rate: convert all to this one."""
    return spans(spark, path, [(offset, count)], rate).drop("span")


def numbered(paths: DataFrame, first: int = 1) -> DataFrame:
    """path, fid: numbers in the order of paths, without bringing them to one task."""
    from tonemark.plans.scratch import materialize

    rows = paths.select("path").distinct().repartitionByRange("path").sortWithinPartitions("path")
    rows = materialize(rows.select("path", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "paths")
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    start: Column = F.lit(first).cast("bigint")
    total = first
    for p, n in counts:
        start, total = F.when(F.col("p") == p, F.lit(total).cast("bigint")).otherwise(start), total + n
    return rows.select("path", (start + F.col("i")).cast("int").alias("fid"))


def write(df: DataFrame, folder: str, rate: int, bits: int = 16, kind: str = "WAV", floats: bool = False) -> None:
    """One file for each row (name, samples), written by the tasks. A task that is run again writes the same files again."""
    if kind not in FORMATS or bits not in BITS or (kind == "FLAC" and bits == 32) or (floats and (kind != "WAV" or bits != 32)):
        raise InvalidParameter(f"{kind} of {bits} bits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import posixpath

        from pyarrow import fs

        made = set()
        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for b in batches:
            for name, x in zip(b["name"], b["samples"], strict=True):
                x = np.asarray(x, dtype=np.float64)
                data = encode(x, rate, 1, bits, floats) if kind == "WAV" else encode_aiff(x, rate, 1, bits) if kind == "AIFF" else encode_flac(x, rate, 1, bits)
                target = posixpath.join(base, name)
                if posixpath.dirname(target) not in made:
                    system.create_dir(posixpath.dirname(target), recursive=True)
                    made.add(posixpath.dirname(target))
                with system.open_output_stream(target + ".part") as out:
                    out.write(data)
                system.move(target + ".part", target)
            yield pd.DataFrame({"n": [len(b)]})

    df.select("name", "samples").mapInPandas(run, "n long").agg(F.sum("n")).collect()
