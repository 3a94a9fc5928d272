"""Title, artist and album from ID3 tags, as metadata of recordings."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FRAMES = {b"TIT2": 0, b"TPE1": 1, b"TALB": 2, b"TT2": 0, b"TP1": 1, b"TAL": 2}


def _text(data: bytes, encoding: str = "latin-1") -> str:
    return data.decode(encoding, "replace").split("\0", 1)[0].strip()


def _frame_text(data: bytes) -> str:
    kinds = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    return _text(data[1:], kinds.get(data[0], "latin-1")) if data else ""


def _number(data: bytes, bits: int) -> int:
    out = 0
    for b in data:
        out = out << bits | b & (1 << bits) - 1
    return out


def tags(data: bytes) -> tuple[str, str, str] | None:
    """Title, artist, album of the tag at the start (versions 2.2 to 2.4), or of the one at the end (version 1); None without a tag."""
    if data[:3] == b"ID3" and len(data) >= 10 and data[3] in (2, 3, 4):
        version, end = data[3], 10 + _number(data[6:10], 7)
        name, head = (3, 6) if version == 2 else (4, 10)
        out, at = ["", "", ""], 10
        if data[5] & 0x40 and version > 2:
            at += _number(data[10:14], 7 if version == 4 else 8) + (0 if version == 4 else 4)
        while at + head <= min(end, len(data)) and data[at] != 0:
            size = _number(data[at + name : at + (6 if version == 2 else 8)], 7 if version == 4 else 8)
            if (k := FRAMES.get(data[at : at + name])) is not None:
                out[k] = _frame_text(data[at + head : at + head + size])
            at += head + size
        return tuple(out)
    if len(data) >= 128 and data[-128:-125] == b"TAG":
        return tuple(_text(data[i:j]) for i, j in ((-125, -95), (-95, -65), (-65, -35)))
    return None


def tag_v1(title: str, artist: str, album: str) -> bytes:
    cut = lambda x: x.encode("latin-1", "replace")[:30].ljust(30, b"\0")
    return b"TAG" + cut(title) + cut(artist) + cut(album) + b"\0" * 35


def tag_v2(title: str, artist: str, album: str) -> bytes:
    frames = b"".join(mark + struct.pack(">IH", len(t) + 1, 0) + b"\x03" + t for mark, t in zip((b"TIT2", b"TPE1", b"TALB"), (x.encode() for x in (title, artist, album)), strict=True))
    size = bytes(len(frames) >> s & 127 for s in (21, 14, 7, 0))
    return b"ID3\x03\0\0" + size + frames


def read(files: DataFrame) -> DataFrame:
    """path, title, artist, album of files (path, content); null without a tag."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *(tags(bytes(c)) or (None, None, None))) for p, c in zip(b["path"], b["content"], strict=True)], columns=["path", "title", "artist", "album"])

    return files.select("path", "content").mapInPandas(run, "path string, title string, artist string, album string")
