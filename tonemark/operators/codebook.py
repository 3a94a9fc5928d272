"""Codebooks of whole descriptors: training by binary k-medians, and the record format.

A record is the number, the sum of distances, the number of points (each 32 bits, little endian) and the centroid.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemark import params as P
from tonemark.errors import InvalidCodebook
from tonemark.operators.quantize import quantize_udf

RECORD = struct.Struct(f"<IfI{P.BYTES}s")


def train(lfs: DataFrame, k: int = P.WORDS, rounds: int = 10, sample: int = 20_000, seed: int = 1) -> DataFrame:
    """word, sum_d, n_points, centroid from descriptors (fid, lid, d). Seeds come from a bounded sample; each round goes over all points.

    A round's new centroids are sums of bits for each word and place: at most P.WORDS arrays of P.BITS numbers.
    """
    spark = lfs.sparkSession
    points = lfs.select("fid", "lid", "d")
    n = max(1, points.count())
    some = points.where(F.pmod(F.xxhash64(F.lit(seed), "fid", "lid"), F.lit(1_000_003)) <= min(1.0, sample / n) * 1_000_003).orderBy("fid", "lid").collect()
    x = np.unpackbits(np.array([list(bytes(r["d"])) for r in some], dtype=np.uint8).reshape(-1, P.BYTES), axis=1, bitorder="little")
    rng = np.random.default_rng(seed)
    chosen = [x[int(rng.integers(len(x)))]]
    near = (x != chosen[0]).sum(axis=1).astype(float)
    while len(chosen) < min(k, len(x)) and near.sum() > 0:
        chosen.append(x[int(rng.choice(len(x), p=near / near.sum()))])
        near = np.minimum(near, (x != chosen[-1]).sum(axis=1))
    book = np.packbits(np.array(chosen), axis=1, bitorder="little")
    stats: dict[int, tuple[float, int]] = {}
    for _ in range(rounds):
        near_df = points.withColumn("q", quantize_udf(book)("d")).select(F.col("q.w").alias("w"), F.col("q.e").alias("e"), "d")

        def sums(batches):
            total: dict[int, list] = {}
            for b in batches:
                bits = np.unpackbits(np.array([list(bytes(d)) for d in b["d"]], dtype=np.uint8).reshape(-1, P.BYTES), axis=1, bitorder="little")
                w = b["w"].to_numpy()
                for c in np.unique(w):
                    at = total.setdefault(int(c), [np.zeros(P.BITS, dtype=np.int64), 0.0, 0])
                    at[0] += bits[w == c].sum(axis=0, dtype=np.int64)
                    at[1] += float(b["e"][w == c].sum())
                    at[2] += int((w == c).sum())
            yield pd.DataFrame([(c, v[0].tolist(), v[1], v[2]) for c, v in total.items()], columns=["w", "ones", "d", "n"])

        parts = near_df.mapInPandas(sums, "w int, ones array<bigint>, d double, n bigint").groupBy("w")
        got = parts.agg(F.array(*[F.sum(F.col("ones")[i]) for i in range(P.BITS)]).alias("ones"), F.sum("d").alias("d"), F.sum("n").alias("n")).collect()
        new, changed = book.copy(), 0
        for r in got:
            ones, old = np.array(r["ones"]), np.unpackbits(book[r["w"]], bitorder="little")
            bits = np.where(2 * ones == r["n"], old, 2 * ones > r["n"]).astype(np.uint8)
            new[r["w"]] = np.packbits(bits, bitorder="little")
            changed += int((bits != old).any()) * r["n"]
            stats[r["w"]] = (r["d"], r["n"])
        book = new
        if changed <= 0.01 * n:
            break
    rows = [(i, *stats.get(i, (0.0, 0)), bytearray(c.tobytes())) for i, c in enumerate(book)]
    return spark.createDataFrame(rows, "word int, sum_d double, n_points bigint, centroid binary")


def to_bytes(codebook: DataFrame) -> bytes:
    """Records of a codebook, in order."""
    rows = sorted(codebook.collect(), key=lambda r: r["word"])
    return b"".join(RECORD.pack(r["word"], r["sum_d"], r["n_points"], bytes(r["centroid"])) for r in rows)


def from_bytes(data: bytes) -> list[tuple[int, float, int, bytes]]:
    if not data or len(data) % RECORD.size:
        raise InvalidCodebook(f"codebook data are a multiple of {RECORD.size} bytes")
    return [RECORD.unpack_from(data, i) for i in range(0, len(data), RECORD.size)]
