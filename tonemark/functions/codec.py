"""Variable-byte code and the layout of encoded postings: seven bits a byte, the low ones first, the high bit on the last byte."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tonemark.errors import InvalidIndexData


def byte_counts(values: np.ndarray) -> np.ndarray:
    """Bytes of each number."""
    n = np.ones(len(values), dtype=np.int64)
    rest = values >> np.uint64(7)
    while rest.any():
        n += rest > 0
        rest = rest >> np.uint64(7)
    return n


def encode_array(values: np.ndarray) -> bytes:
    values = values.astype(np.uint64)
    n = byte_counts(values)
    ends = n.cumsum()
    of = np.repeat(np.arange(len(values)), n)
    place = np.arange(len(of)) - (ends - n)[of]
    out = (values[of] >> (7 * place).astype(np.uint64) & np.uint64(127)).astype(np.uint8)
    out[ends - 1] |= 128
    return out.tobytes()


def decode_array(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(raw & 128)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise InvalidIndexData("the data end inside a number")
    starts = np.concatenate([[0], ends[:-1] + 1])
    of = np.repeat(np.arange(len(ends)), ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * (np.arange(len(raw)) - starts[of]), starts)


def encode_ints(values: Sequence[int]) -> bytes:
    return encode_array(np.array(values, dtype=np.uint64)) if len(values) else b""


def decode_ints(data: bytes) -> list[int]:
    return decode_array(data).tolist()


def encode_postings(rows: Sequence[tuple[int, Sequence[tuple[int, int, int]]]], before: int = 0) -> bytes:
    """rows: (fid, [(lid, t, e), ...]) in order. Differences of fids, and of lids and ts within a posting; errors as they are."""
    flat: list[int] = []
    for fid, occ in rows:
        flat += [fid - before, len(occ)]
        for part in range(2):
            last = 0
            for o in occ:
                flat.append(o[part] - last)
                last = o[part]
        flat += [o[2] for o in occ]
        before = fid
    return encode_ints(flat)


def decode_postings(data: bytes, before: int = 0) -> list[tuple[int, list[tuple[int, int, int]]]]:
    flat, at, out = decode_ints(data), 0, []
    while at < len(flat):
        if at + 2 > len(flat) or at + 2 + 3 * flat[at + 1] > len(flat):
            raise InvalidIndexData("a posting is cut off")
        before += flat[at]
        n = flat[at + 1]
        parts = [flat[at + 2 + i * n : at + 2 + (i + 1) * n] for i in range(3)]
        for p in parts[:2]:
            for i in range(1, n):
                p[i] += p[i - 1]
        out.append((before, list(zip(*parts, strict=True))))
        at += 2 + 3 * n
    return out


def encoded(values: Column) -> Column:
    """Arrays of integers to bytes."""

    @F.pandas_udf("binary")
    def encode(v: pd.Series) -> pd.Series:
        return v.map(lambda x: encode_array(np.asarray(x)) if len(x) else b"")

    return encode(values)


def decoded(data: Column) -> Column:
    """Bytes to arrays of integers."""

    @F.pandas_udf("array<bigint>")
    def decode(v: pd.Series) -> pd.Series:
        return v.map(lambda x: decode_array(bytes(x)))

    return decode(data)


class DecodeInts:
    """A table function: position and value of each number in variable-byte data."""

    def eval(self, data: bytes):
        for i, v in enumerate(decode_ints(bytes(data or b""))):
            yield i, v


def register(spark) -> None:
    """Makes vbyte_decode(data) a table function of the session."""
    spark.udtf.register("vbyte_decode", F.udtf(DecodeInts, returnType="pos int, value bigint"))
