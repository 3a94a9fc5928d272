"""Fingerprint store: Parquet tables for index, fingerprints, metadata and the store's match type, and sessions that add to it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemark import params as P
from tonemark.errors import InvalidFingerprint, InvalidIndexData, InvalidIndexerState, InvalidParameter
from tonemark.operators import index

SCHEMAS = {
    "index": "term int, fid int, lid int, t int, e int",
    "delta": "term int, fid int, lid int, t int, e int",
    "fingerprints": "fid int, lid int, t int, f int, w int, e int",
    "metadata": "fid int, meta string",
    "info": "match_type string",
}


class FingerprintStore:
    """mode: GET reads, BUILD adds to the index at once, BUILD_MERGE adds to a delta that merge() moves into the index."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "GET"):
        if mode not in ("GET", "BUILD", "BUILD_MERGE"):
            raise InvalidParameter(f"mode {mode}")
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode

    def read(self, name: str) -> DataFrame:
        """A table; empty if it was never written."""
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def _write(self, df: DataFrame, name: str, how: str = "append") -> None:
        if self.mode == "GET":
            raise InvalidIndexerState("the store is open for reading")
        fields = [F.col(f.split()[0]).cast(f.split()[1]) for f in SCHEMAS[name].split(", ")]
        df.select(fields).write.mode(how).parquet(f"{self.path}/{name}")

    def clear(self) -> None:
        for name in SCHEMAS:
            self._write(self.spark.createDataFrame([], SCHEMAS[name]), name, "overwrite")

    def is_empty(self) -> bool:
        return self.read("index").isEmpty() and self.read("fingerprints").isEmpty()

    def fingerprints_count(self) -> int:
        return self.read("fingerprints").select("fid").distinct().count()

    def match_type(self) -> str | None:
        row = self.read("info").first()
        return row["match_type"] if row else None

    def put_metadata(self, rows: DataFrame) -> None:
        self._write(rows, "metadata")

    def metadata(self, fids: DataFrame) -> DataFrame:
        """fids (fid) and their meta, empty where there is none."""
        return fids.join(self.read("metadata"), "fid", "left").withColumn("meta", F.coalesce("meta", F.lit("")))

    def postings(self, term: int) -> DataFrame:
        """A term's list. Files are sorted by term, so that statistics skip most of them."""
        return index.postings(self.read("index").where(F.col("term") == term))

    def block_headers(self, term: int | None = None) -> DataFrame:
        """Headers of the blocks that the lists, or one, take in the block format: term, block, body_size, fid_max, block_count."""
        rows = self.read("index")
        return index.block_headers(index.layout(rows if term is None else rows.where(F.col("term") == term)))

    def fingerprint(self, fid: int, first: int = 0, count: int | None = None) -> DataFrame:
        """Fingerprints of a recording from `first`, to its end if count is None."""
        rows = self.read("fingerprints").where((F.col("fid") == fid) & (F.col("lid") >= first))
        return rows if count is None else rows.where(F.col("lid") < first + count)

    def put_fingerprints(self, qlf: DataFrame) -> None:
        self._write(qlf.repartitionByRange("fid").sortWithinPartitions("fid", "lid"), "fingerprints")

    def add_postings(self, rows: DataFrame) -> None:
        name = "delta" if self.mode == "BUILD_MERGE" else "index"
        self._write(rows.repartitionByRange("term").sortWithinPartitions("term", "fid", "lid"), name)

    def merge(self) -> None:
        """Appends the delta to the index and empties it. Recordings of the delta must be newer than any in the index."""
        live, delta = self.read("index"), self.read("delta")
        old, new = live.agg(F.max("fid")).first()[0], delta.agg(F.min("fid")).first()[0]
        if new is None:
            return
        if old is not None and new <= old:
            raise InvalidIndexData(f"recording {new} of the delta is not newer than {old}")
        self._write(delta.repartitionByRange("term").sortWithinPartitions("term", "fid", "lid"), "index")
        self._write(self.spark.createDataFrame([], SCHEMAS["delta"]), "delta", "overwrite")

    def compact(self, other: FingerprintStore) -> None:
        """Writes the index once more, sorted by term, into another store: one run of files instead of one for each session."""
        other._write(self.read("index").repartitionByRange("term").sortWithinPartitions("term", "fid", "lid"), "index", "overwrite")


class IndexSession:
    """start(), then index() as often as wanted, then end(). Recordings come with growing numbers. duplicates: pairs that gave a fingerprint a term it had already."""

    def __init__(self, store: FingerprintStore, match_type: str = "MSCALE"):
        if match_type not in P.MATCH_TYPES:
            raise InvalidParameter(f"match type {match_type}")
        self.store, self.match_type, self.open, self.duplicates = store, match_type, False, 0

    def start(self) -> None:
        if self.open:
            raise InvalidIndexerState("the session has started already")
        kept = self.store.match_type()
        if kept and kept != self.match_type:
            raise InvalidParameter(f"the store is for {kept}")
        if not kept:
            self.store._write(self.store.spark.createDataFrame([(self.match_type,)], SCHEMAS["info"]), "info", "overwrite")
        self.open = True

    def index(self, qlf: DataFrame, keep: bool = True) -> None:
        """qlf: fid, lid, t, f, w, e of one or many recordings. keep: also store the fingerprints."""
        if not self.open:
            raise InvalidIndexerState("the session hasn't started")
        broken = index.invariants(qlf).where("violations > 0").collect()
        if broken:
            raise InvalidFingerprint(", ".join(f"{r['rule']}: {r['violations']}" for r in broken))
        tables = ("index", "delta")
        last = max((x for t in tables if (x := self.store.read(t).agg(F.max("fid")).first()[0]) is not None), default=0)
        first = qlf.agg(F.min("fid")).first()[0]
        if first is None:
            return
        if first <= last:
            raise InvalidParameter(f"recording {first} is not newer than {last}")
        rows = index.build(qlf, self.match_type)
        if self.match_type == "XSCALE":
            self.duplicates += index.pair_terms(qlf).count() - rows.count()
        if keep:
            self.store.put_fingerprints(qlf)
        self.store.add_postings(rows)

    def end(self) -> None:
        if not self.open:
            raise InvalidIndexerState("the session hasn't started")
        if self.store.mode == "BUILD_MERGE":
            self.store.merge()
        self.open = False


@contextmanager
def session(store: FingerprintStore, match_type: str = "MSCALE") -> Iterator[IndexSession]:
    s = IndexSession(store, match_type)
    s.start()
    try:
        yield s
    finally:
        s.end()


def reindex(source: FingerprintStore, target: FingerprintStore, match_type: str) -> None:
    """Builds another store's index from the fingerprints of one. The fingerprints are not stored again."""
    with session(target, match_type) as s:
        s.index(source.read("fingerprints"), keep=False)
