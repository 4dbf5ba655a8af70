"""Bursts of changes in two stateful steps, so that no key gathers all events.

The first step counts changes by time window of one gap and by bucket of their path, in append mode: its state is spread over all
partitions and leaves as the watermark passes. Changes of one window are less than a gap apart, so they are of one burst, and a window's first and last time are
all that the second step needs of it: it joins those points to bursts by session windows. Its key is one, but it gets two rows for each window and bucket in which
something happened, however many changes there were. The steps are two queries with a written table between them, each with its checkpoint; a run takes
what is there and a later one goes on. Changes later than `delay` are lost. `close` ends the stream: what is open comes out, and later changes are
late ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "at timestamp, changes long, paths array<string>"
BURSTS = "start timestamp, end timestamp, changes long, paths array<string>"
END = "9999-01-01 00:00:00"


class BurstStream:
    """Bursts of changes (ts timestamp, path) below a shared folder; `then` gets each batch of finished bursts and its number, as foreachBatch gives them."""

    def __init__(self, spark: SparkSession, folder: str, gap_us: int = 5_000_000, delay: str = "1 minute", buckets: int = 32, then: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.folder, self.gap_us, self.delay, self.buckets, self.then = spark, folder.rstrip("/"), gap_us, delay, buckets, then
        for name, schema in (("marks", "ts timestamp, path string"), ("points/batch=-2", POINTS), ("bursts/batch=-2", BURSTS)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{name}")

    def _run(self, stream: DataFrame, name: str, more: Callable[[DataFrame, int], None] | None = None) -> None:
        def sink(df: DataFrame, n: int) -> None:
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={n}")  # a batch that is tried again replaces itself
            if more:
                more(self.spark.read.schema(BURSTS).parquet(f"{self.folder}/{name}/batch={n}"), n)

        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{self.folder}/{name}-at").trigger(availableNow=True).start().awaitTermination()

    def run(self, changes: DataFrame) -> None:
        """Take what is new of a stream of changes."""
        marks = self.spark.readStream.schema("ts timestamp, path string").parquet(f"{self.folder}/marks")
        rows = changes.select("ts", "path").unionByName(marks).where("ts is not null").withWatermark("ts", self.delay)
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets))
        seen = rows.groupBy(F.window("ts", f"{self.gap_us} microseconds").alias("w"), bucket.alias("bucket")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("changes"), F.collect_set("path").alias("paths"))
        both = F.explode(F.array(F.struct(F.col("first").alias("at"), "changes", "paths"), F.struct(F.col("last").alias("at"), F.lit(0).cast("long").alias("changes"), F.array().cast("array<string>").alias("paths"))))
        self._run(seen.select(both.alias("p")).select("p.*"), "points")
        # Later windows end after those that have come out, so their points are at most a gap older than the newest.
        points = self.spark.readStream.schema(POINTS).parquet(f"{self.folder}/points").withWatermark("at", f"{self.gap_us} microseconds").withColumn("all", F.lit(True))
        # A change just a gap after the last begins another burst; Spark's sessions would still take it, hence the microsecond.
        one = points.groupBy(F.session_window("at", f"{self.gap_us - 1} microseconds").alias("w"), "all").agg(F.sum("changes").alias("changes"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("paths")))).alias("paths"))
        self._run(one.select(F.col("w.start").alias("start"), (F.col("w.end") + F.expr("interval 1 microsecond")).alias("end"), "changes", "paths"), "bursts", self.then)

    def close(self, changes: DataFrame) -> None:
        """End the stream: a mark after all time passes both steps."""
        self.spark.createDataFrame([(None,)], "path string").select(F.lit(END).cast("timestamp").alias("ts"), "path").coalesce(1).write.mode("append").parquet(f"{self.folder}/marks")
        self.spark.createDataFrame([(0, [])], "changes long, paths array<string>").select(F.lit(END).cast("timestamp").alias("at"), "changes", "paths").coalesce(1).write.mode("ignore").parquet(f"{self.folder}/points/batch=-1")
        self.run(changes)

    def bursts(self) -> DataFrame:
        return self.spark.read.schema(BURSTS).parquet(f"{self.folder}/bursts").select("start", "end", "changes", "paths")
