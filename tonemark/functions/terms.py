"""Columns that turn quantised fingerprints into terms and scores. All integer, but for the quotient of pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonemark import params as P


def channel(f: Column) -> Column:
    return F.floor((f - (P.K_MIN - 1)) / int(P.QF)).cast("int")


def single_term(w: Column, f: Column) -> Column:
    return (w * 64).cast("int").bitwiseOR(channel(f))


def band(f: Column) -> Column:
    return F.floor(f / P.BAND).cast("int")


def steps(a: Column, b: Column, unit: float) -> Column:
    """Units from a to b: the two quotients in 32 bits, their difference cut off. Integer division differs at multiples of the unit."""
    q = lambda x: (x.cast("double") / F.lit(unit)).cast("float")
    return (q(b) - q(a)).cast("int")


def pair_term(w1: Column, band_: Column, w2: Column, vpt: Column, vpf: Column) -> Column:
    parts = [w1 * (1 << P.W1_SHIFT), band_ * (1 << P.B_SHIFT), w2 * (1 << P.W2_SHIFT), vpt * (1 << P.VPT_SHIFT)]
    out = vpf.bitwiseAND(F.lit(63))
    for p in parts:
        out = out.bitwiseOR(p)
    return out.cast("int")


def time_bin(t: Column) -> Column:
    return F.floor(t / P.BIN).cast("int")


def similarity(e1: Column, e2: Column) -> Column:
    return F.floor(P.MAX_SCORE * (P.BITS - F.abs(e1 - e2)) / P.BITS).cast("bigint")


def cue_point(bin_: Column) -> Column:
    """Seconds at the middle of a time bin."""
    return ((P.BIN * bin_ + P.BIN // 2) * P.DT).cast("int")


def batch_confidence(top1: Column, top2: Column) -> Column:
    return 2 * top1 / (top1 + F.coalesce(top2, F.lit(0))) - 1


def step_confidence(top1: Column, top2: Column) -> Column:
    return top1 / (top1 + F.coalesce(top2, F.lit(0)))


def quantised(x: Column, unit: int) -> Column:
    """Nearest multiple, halves up: (2x + unit) div (2 unit)."""
    return F.floor((2 * x + unit) / (2 * unit)).cast("int")


def edge_hash(tij: Column, fij: Column, tir: Column, fir: Column) -> Column:
    """Four differences, eight bits each."""
    low = lambda x: x.cast("bigint").bitwiseAND(F.lit(255).cast("bigint"))
    return low(tij) * (1 << 24) + low(fij) * (1 << 16) + low(tir) * (1 << 8) + low(fir)


def max_term(match_type: str) -> int:
    """The largest term."""
    if match_type == "MSCALE":
        return P.WORDS << 6 | P.CHANNELS
    return P.WORDS << P.W1_SHIFT | 3 << P.B_SHIFT | P.WORDS << P.W2_SHIFT | P.PAIR_T << P.VPT_SHIFT | P.PAIR_F + 22
