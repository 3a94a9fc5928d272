"""A Python data source: spark.read.format("tonemark_wav").load(folder) gives path, sample_rate, channels, samples; a stream of it does, too."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "path string, sample_rate int, channels int, samples array<float>"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def listed(folder: str) -> list[str]:
    base = folder.removeprefix("file://").removeprefix("file:")
    return sorted(p for p in glob.glob(os.path.join(base, "**", "*"), recursive=True) if p.lower().endswith(".wav"))


def rows(paths: list[str], rate: int | None) -> Iterator[tuple]:
    from tonemark.sources.wav import decoded

    for p in paths:
        with open(p, "rb") as f:
            found = decoded(f.read(), rate=rate)
        yield (p, found[0], found[1], found[2].tolist() if found[2] is not None else None)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.rate, self.per = options["path"], int(options["rate"]) if "rate" in options else None, int(options.get("files", "16"))

    def partitions(self) -> list[Files]:
        found = listed(self.folder)
        return [Files(found[i : i + self.per]) for i in range(0, len(found), self.per)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from rows(partition.paths, self.rate)


class StreamReader(SimpleDataSourceStreamReader):
    """Files in the order of their names, at most `files` in a micro-batch: the offset is the last name read."""

    def __init__(self, options: dict):
        self.folder, self.rate, self.per = options["path"], int(options["rate"]) if "rate" in options else None, int(options.get("files", "16"))

    def initialOffset(self) -> dict:
        return {"last": ""}

    def read(self, start: dict):
        found = [p for p in listed(self.folder) if p > start["last"]][: self.per]
        return iter(list(rows(found, self.rate))), {"last": found[-1] if found else start["last"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(rows([p for p in listed(self.folder) if start["last"] < p <= end["last"]], self.rate)))


class WavSource(DataSource):
    """options: rate (convert all files to it), files (of a task, or of a micro-batch)."""

    @classmethod
    def name(cls) -> str:
        return "tonemark_wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def simpleStreamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)
