"""Continuous identification of many streams: state per stream in tables, the same plan in each micro-batch.

A micro-batch appends its fingerprints to each stream's open query, identifies all open queries at once, emits those that
are decided and drops their state; the others wait for more. A stream that stays silent for some micro-batches ends
without a match. Nothing is lost under load: a slow batch only makes the next one larger, within maxFilesPerTrigger. What a
batch wrote in between is removed at its end, and of the state the last two batches stay, so that a batch can be run again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonemark.plans import engine
from tonemark.plans.scratch import remove, scope, shared_dir

FINGERPRINTS = "query_id int, block_no int, lid int, t int, f int, w int, e int"
STATE = FINGERPRINTS + ", seen long"
RESULT = "query_id int, status string, fid int, confidence double, score double, id_class string, cue_point int, id_time double"


class Monitor:
    """foreachBatch target. continuous: after a decision a stream starts a new query; else it is done for good. idle: micro-batches without data after which a stream's open query ends, 0 for never."""

    def __init__(self, spark: SparkSession, postings: DataFrame, recordings: DataFrame, folder: str, config: engine.Config | None = None, continuous: bool = False, idle: int = 0):
        self.spark, self.postings, self.recordings = spark, postings, recordings
        self.folder, self.config, self.continuous, self.idle = folder.rstrip("/"), config or engine.Config(), continuous, idle

    def _state(self, batch: int) -> str:
        return f"{self.folder}/state/{batch}"

    def _last(self, batch: int) -> DataFrame:
        """State before a batch: the folder of the batch before it, so that a batch that is run again starts from the same."""
        if batch == 0:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(self._state(batch - 1))

    def _decided(self, batch: int) -> DataFrame:
        """Streams that earlier batches have decided."""
        if batch == 0:
            return self.spark.createDataFrame([], "query_id int")
        return self.spark.read.schema(RESULT + ", batch int").parquet(f"{self.folder}/results").where(F.col("batch") < batch).select("query_id").distinct()

    def __call__(self, new: DataFrame, batch: int) -> None:
        self.spark = new.sparkSession
        with scope(self.spark):
            self._run(new, batch)
        if batch > 1:
            remove(self.spark, self._state(batch - 2))

    def _run(self, new: DataFrame, batch: int) -> None:
        spark = self.spark
        old = self._last(batch)
        raw = old.unionByName(new.select(*[c for c in old.columns if c != "seen"]).withColumn("seen", F.lit(batch).cast("bigint")))
        if not self.continuous:
            raw = raw.join(self._decided(batch), "query_id", "left_anti")
        raw = raw.persist()
        rows = raw.drop("seen")
        if self.continuous:  # after a decision numbers, times and steps start from zero again
            w = Window.partitionBy("query_id")
            rows = rows.withColumns({"l0": F.min("lid").over(w), "t0": F.min("t").over(w), "b0": F.min("block_no").over(w)})
            rows = rows.select("query_id", (F.col("block_no") - F.col("b0")).alias("block_no"), (F.col("lid") - F.col("l0")).alias("lid"), (F.col("t") - F.col("t0")).alias("t"), "f", "w", "e")
        out = f"{self.folder}/results/batch={batch}"
        got = engine.identify(rows, self.postings, self.recordings, self.config)
        if self.idle:
            silent = raw.groupBy("query_id").agg(F.max("seen").alias("seen")).where(F.col("seen") <= batch - self.idle).select("query_id", F.lit("NO_MATCH").alias("over"))
            got = got.join(silent, "query_id", "left").withColumn("status", F.when(F.col("status") == "PENDING", F.coalesce("over", "status")).otherwise(F.col("status"))).drop("over")
        got.where("status <> 'PENDING'").write.mode("overwrite").parquet(out)
        decided = spark.read.schema(RESULT).parquet(out).select("query_id").distinct()
        raw.join(decided, "query_id", "left_anti").write.mode("overwrite").parquet(self._state(batch))
        raw.unpersist()

    def results(self) -> DataFrame:
        """Decisions so far, with the number of their batch where streams go on after one."""
        rows = self.spark.read.schema(RESULT + ", batch int").parquet(f"{self.folder}/results")
        return rows if self.continuous else rows.drop("batch")


def stored(spark: SparkSession, path: str, schema: str = FINGERPRINTS, files: int = 100) -> DataFrame:
    """A stream of Parquet files that arrive in a folder, at most so many in a micro-batch: under load files wait, none is lost."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def start(chunks: DataFrame, monitor: Monitor, checkpoint: str, **trigger):
    """Starts the monitor on a streaming DataFrame of fingerprints (query_id, block_no, lid, t, f, w, e)."""
    writer = chunks.writeStream.foreachBatch(monitor).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def run_once(queries: DataFrame, postings: DataFrame, recordings: DataFrame, steps: int = 3, config: engine.Config | None = None) -> DataFrame:
    """Streams stored queries through files, `steps` groups of blocks one after another, and returns the decisions."""
    spark = queries.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last = int(queries.agg(F.max("block_no")).first()[0] or 0)
    width = -(-(last + 1) // steps)
    postings.write.parquet(f"{base}/postings")
    recordings.write.parquet(f"{base}/recordings")
    read = lambda name, df: spark.read.schema(df.schema).parquet(f"{base}/{name}")
    monitor = Monitor(spark, read("postings", postings), read("recordings", recordings), base, config)
    for i in range(steps):
        part = queries.where((F.col("block_no") >= i * width) & (F.col("block_no") < (i + 1) * width))
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        start(stored(spark, f"{base}/in"), monitor, f"{base}/checkpoint", availableNow=True).awaitTermination()
    return monitor.results()


def drained(rows: DataFrame, name: str) -> DataFrame:
    """Runs a streaming aggregation over all files that are there, and returns its whole result."""
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    save = lambda df, batch: df.write.mode("overwrite").parquet(f"{base}/out")
    stream = rows.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{base}/checkpoint")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by user and window; rows later than the watermark are dropped. events: ts, user_id, value; batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.window("ts", size).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Like tumbling, for windows that overlap: each row counts in size / slide of them."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Events by user and session, which ends after a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
