"""Columns over arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(samples: Column, bits: int = 16) -> Column:
    """Integers to [-1, 1)."""
    return F.transform(samples, lambda x: (x / float(1 << (bits - 1))).cast("float"))


def gain(samples: Column, factor: float) -> Column:
    """Multiplied and clamped to [-1, 1]."""
    return F.transform(samples, lambda x: F.greatest(F.least(x * factor, F.lit(1.0)), F.lit(-1.0)))


def _cut(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def mix(a: Column, b: Column) -> Column:
    """Mean of two blocks, as long as the shorter one."""
    x, y = _cut(a, b)
    return F.zip_with(x, y, lambda p, q: (p + q) / 2)


def mix_channels(a: Column, b: Column, channels: int) -> Column:
    """Sum divided by the number of channels."""
    x, y = _cut(a, b)
    return F.zip_with(x, y, lambda p, q: (p + q) / channels)


def power(samples: Column) -> Column:
    """Mean square; 0 if empty."""
    return F.when(F.size(samples) == 0, 0.0).otherwise(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x * x) / F.size(samples))


def snr(signal: Column, noise: Column) -> Column:
    """Decibels; null without noise."""
    return F.when(noise > 0, 10 * F.log10(signal / noise))


def sub_block(samples: Column, start: int, size: int) -> Column:
    return F.slice(samples, start + 1, size)


def append(a: Column, b: Column, capacity: int) -> Column:
    """Joined and cut to the capacity."""
    return F.slice(F.concat(a, b), 1, capacity)


def duration(samples: Column, rate: int, channels: int = 1) -> Column:
    return F.size(samples) / (rate * channels)


def format_time(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int"))


def supported(path: Column) -> Column:
    """Whether the file's extension, in any case, is one of the known formats."""
    return F.upper(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("WAV", "AIFF", "AU", "CDA", "FLAC", "MP3", "M4A", "AAC", "OGG")


def described(title: Column, artist: Column, path: Column) -> Column:
    """'title by artist', or the file's name where there is no title."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    by = F.concat_ws(" by ", F.when(title != "", title), F.when(artist != "", artist))
    return F.when(title.isNull() | (title == ""), name).otherwise(by)


def truth_id(path: Column) -> Column:
    """A clip's recording: its file's stem up to the first '_'."""
    return F.substring_index(F.regexp_extract(path, r"([^/\\]+?)(?:\.[^.]*)?$", 1), "_", 1)
