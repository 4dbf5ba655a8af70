"""Workflows of a user: what was copied last becomes a memory, the state as a text, knowledge as files of each topic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from . import assist, intake
from .counters import Counters

#: What a remembered clipboard counts for, and the lines of a state.
CLIPBOARD_TYPE, CLIPBOARD_IMPORTANCE = "working", 0.6
STATE = "Brain Status: healthy\nMemories: %d, Thoughts: %d, Experiences: %d\nLearning Trend: %s\nRecent Thoughts:\n%s"


def remember_clipboard(store, copied: DataFrame, counters: Counters, embed: Callable[[Column], Column] = vectors.hash_embedding) -> DataFrame:
    """The newest text of `copied` (content, timestamp) becomes a memory of the store; of two at one time the greater by content. One row: success, id, preview; without a
    text that isn't empty success is false. Its id follows time and content, so asking twice stores it once."""
    last = copied.where("content <> ''").agg(F.max(F.struct("timestamp", "content")).alias("r")).where("r is not null").select("r.*")
    name = F.concat(F.lit("clip-"), F.substring(F.sha2(F.concat_ws("\x00", F.col("timestamp").cast("string"), "content"), 256), 1, 32))
    row = last.select(name.alias("id"), "content", F.lit(CLIPBOARD_TYPE).alias("memory_type"), F.lit(CLIPBOARD_IMPORTANCE).alias("importance"), "timestamp").first()
    spark = copied.sparkSession
    if row is None:
        return spark.createDataFrame([(False, None, None)], "success boolean, id string, preview string")
    one = spark.createDataFrame([row.asDict()], "id string, content string, memory_type string, importance double, timestamp long")
    intake.remember_texts(store, one, counters, embed, least_bytes=1)
    return one.select(F.lit(True).alias("success"), "id", F.substring("content", 1, 100).alias("preview"))


def state_text(introspection: DataFrame, thoughts: DataFrame, shown: int = 5, chars: int = 80) -> DataFrame:
    """One row, message: the state (`browse.introspection`) and the newest thoughts (id, kind, content, timestamp), each cut to some characters."""
    line = F.concat(F.lit("  - ["), "kind", F.lit("] "), F.substring("content", 1, chars))
    last = thoughts.orderBy(F.desc("timestamp"), F.desc("id")).limit(shown).select(F.struct("timestamp", "id", line.alias("line")).alias("r"))
    lines = last.agg(F.array_join(F.transform(F.sort_array(F.collect_list("r"), asc=False), lambda x: x["line"]), "\n").alias("lines"))
    return introspection.crossJoin(F.broadcast(lines)).select(F.format_string(STATE, "memories", "thoughts", "experiences", "trend", "lines").alias("message"))  # one row each


def write_topics(memories: DataFrame, topic: str, folder: str, most: int = 10_000) -> None:
    """A folder of markdown files for each topic of memories (id, content, timestamp), oldest first: their texts one after the other, in the order of the names, are `assist.topic_text`. Rows are
    put in order by ranges, so a topic of very many memories is written by many tasks, and a file holds at most `most` of them. Memories without a topic go to Hive's default folder."""
    entry = F.concat(F.lit("### "), "id", F.lit("\n"), "content", F.lit("\n"))
    rows = memories.select(F.col(topic).cast("string").alias("topic"), F.lit(1).alias("nth"), "timestamp", "id", entry.alias("value")).where("value is not null")
    heads = rows.select("topic").distinct().select("topic", F.lit(0).alias("nth"), F.lit(None).cast(rows.schema["timestamp"].dataType).alias("timestamp"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("# "), F.coalesce("topic", F.lit("")), F.lit("\n")).alias("value"))
    order = ["topic", "nth", "timestamp", "id"]
    ranged = rows.withColumn("id", F.col("id").cast("string")).unionByName(heads).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("topic", "value").write.partitionBy("topic").option("maxRecordsPerFile", most).text(folder)


def read_topics(spark: SparkSession, folder: str) -> DataFrame:
    """topic, id, content of the files that `write_topics` wrote; a row for each file is whole in a task, not more."""
    files = spark.read.schema("value string, topic string").text(folder, wholetext=True)
    return assist.topic_entries(files.select("topic", F.col("value").alias("body")))
