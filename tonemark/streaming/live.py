"""Fingerprints of live audio: chunks of many streams, each stream's overlap and numbers kept as state.

The rows are those that the whole recording, cut into the same chunks, would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemark import params as P
from tonemark.operators.quantize import codes
from tonemark.operators.signal import Fingerprinter
from tonemark.sources import wav

ROWS = "query_id int, block_no int, lid int, t int, f int, d binary"
CODED = "query_id int, block_no int, lid int, t int, f int, w int, e int"
STATE = "tail binary, frames int, count int"


def fingerprints(chunks: DataFrame, silence: str | None = None, codebook: np.ndarray | None = None) -> DataFrame:
    """query_id, block_no, lid, t, f, d of a stream of chunks (query_id, block_no, samples); chunks of a stream come in order of block_no.

    With a codebook w and e in place of d: the monitor's input.

    A chunk of over QUERY_SECONDS is cut there. silence: how long a stream's state waits for more, for ever if None.
    """
    most = int(P.QUERY_SECONDS * P.SAMPLE_RATE)

    def each(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        f = Fingerprinter()
        if state.exists:
            tail, f.frames, f.count = state.get
            f.tail = np.frombuffer(bytes(tail), dtype=np.float32)
        rows = []
        part = pd.concat(list(parts)).sort_values("block_no")
        for no, samples in zip(part["block_no"], part["samples"], strict=True):
            rows += [(key[0], int(no), *r) for r in f.process(np.asarray(samples, dtype=np.float32)[:most])]
        state.update((f.tail.astype(np.float32).tobytes(), f.frames, f.count))
        if silence:
            state.setTimeoutDuration(silence)
        out = pd.DataFrame(rows, columns=["query_id", "block_no", "lid", "t", "f", "d"])
        if codebook is not None:
            x = np.frombuffer(b"".join(out.pop("d")), dtype=np.uint8).reshape(-1, P.BYTES)
            out["w"], out["e"] = codes(x, codebook)
        yield out

    timeout = "ProcessingTimeTimeout" if silence else "NoTimeout"
    return chunks.groupBy("query_id").applyInPandasWithState(each, ROWS if codebook is None else CODED, STATE, "append", timeout)


def chunk_files(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    """A stream of chunks from WAV files named <stream>_<number>.wav that arrive in a folder, at most so many in a micro-batch."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.wav").option("maxFilesPerTrigger", files).load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [wav.decoded(bytes(c), rate=P.SAMPLE_RATE)[2] for c in b["content"]]
            yield pd.DataFrame({"query_id": b["query_id"], "block_no": b["block_no"], "samples": got})[lambda x: x["samples"].notna()]

    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    rows = found.select(F.split_part(name, F.lit("_"), F.lit(1)).cast("int").alias("query_id"), F.split_part(name, F.lit("_"), F.lit(2)).cast("int").alias("block_no"), "content")
    return rows.where("query_id is not null and block_no is not null").mapInPandas(run, "query_id int, block_no int, samples array<float>")
