"""The life of memories: every change takes a table and gives the next state of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def store(existing: DataFrame, new: DataFrame, dim: int | None = None) -> DataFrame:
    """New rows appended; ids that are there are skipped, vectors of another dimension too."""
    rows = new if dim is None else new.where(F.size("vector") == dim)
    return existing.unionByName(rows.join(existing.select("id"), "id", "left_anti").select(*existing.columns))


def consolidate(memories: DataFrame, decay_above: float = 0.9, importance_below: float = 0.3, step: float = 0.01) -> DataFrame:
    """Faded and unimportant memories go; the decay of all others grows by a step."""
    gone = (F.col("decay") > decay_above) & (F.col("importance") < importance_below)
    return memories.where(~gone).withColumn("decay", F.col("decay") + step)


def evict(memories: DataFrame, capacity: int) -> DataFrame:
    """Above capacity, the excess and a tenth of the capacity go: those with the least importance * (1 - decay)."""
    n = memories.count()
    if n <= capacity:
        return memories
    gone = memories.select("id", (F.col("importance") * (1 - F.col("decay"))).alias("s")).orderBy("s", "id").limit(n - capacity + capacity // 10)
    return memories.join(gone.select("id"), "id", "left_anti")


def apply_access(memories: DataFrame, hits: DataFrame) -> DataFrame:
    """Hit memories count their accesses and lose their decay."""
    counts = hits.groupBy("id").agg(F.count("*").alias("hits"))
    joined = memories.join(counts, "id", "left")
    return joined.withColumns({"access_count": F.col("access_count") + F.coalesce("hits", F.lit(0)), "decay": F.when(F.col("hits").isNotNull(), 0.0).otherwise(F.col("decay"))}).drop("hits")


def update(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Columns of changes that are not null replace the old values."""
    fields = [c for c in changes.columns if c != "id"]
    joined = memories.join(changes.select("id", *[F.col(c).alias(f"new_{c}") for c in fields]), "id", "left")
    return joined.withColumns({c: F.coalesce(f"new_{c}", c) for c in fields}).select(*memories.columns)


def connect(memories: DataFrame, links: DataFrame) -> DataFrame:
    """Both ends of each link (a, b) get the other in `connections`, once; links with a missing end do nothing."""
    known = memories.select("id")
    good = links.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    both = good.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(good.select(F.col("b").alias("id"), F.col("a").alias("o")))
    return memories.join(both.groupBy("id").agg(F.sort_array(F.collect_set("o")).alias("more")), "id", "left").withColumn("connections", F.array_union("connections", F.coalesce("more", F.array().cast("array<string>")))).drop("more")


def stats(memories: DataFrame) -> DataFrame:
    return memories.agg(
        F.count("*").alias("n"), F.coalesce(F.avg("importance"), F.lit(0.0)).alias("avg_importance"), F.coalesce(F.avg("decay"), F.lit(0.0)).alias("avg_decay"), F.coalesce(F.sum("access_count"), F.lit(0)).cast("bigint").alias("accesses")
    )


def compression(memories: DataFrame) -> DataFrame:
    """Tiers by share of all accesses and the estimated saving in percent."""
    total = memories.agg(F.sum("access_count").alias("total"))
    share = F.col("access_count") / F.greatest("total", F.lit(1))
    counts = memories.crossJoin(F.broadcast(total)).agg(
        F.count_if(share > 0.8).alias("hot"), F.count_if((share > 0.4) & (share <= 0.8)).alias("warm"), F.count_if(share <= 0.4).alias("cold"), F.count("*").alias("n")
    )
    return counts.select("hot", "warm", "cold", F.round((F.col("warm") * 50 + F.col("cold") * 75) / F.greatest("n", F.lit(1)), 1).alias("savings_percent"))


def unbridged(memories: DataFrame, refs: DataFrame, limit: int) -> DataFrame:
    return memories.join(refs.select("id"), "id", "left_anti").orderBy("timestamp", "id").limit(limit)


def page(memories: DataFrame, memory_type: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    rows = memories.where(F.lower("memory_type") == memory_type.lower()) if memory_type else memories
    return rows.orderBy(F.desc("timestamp"), "id").offset(offset).limit(limit)


def needs(stats_row, capacity: int) -> list[str]:
    """What a maintenance cycle should do, from one row of stats()."""
    out = []
    if stats_row["avg_decay"] > 0.5:
        out.append("consolidate")
    if stats_row["n"] > 0.8 * capacity:
        out.append("evict")
    return out


def goal_status(progress: F.Column) -> F.Column:
    return F.when(progress >= 1, "Completed").when(progress > 0, "Active").otherwise("Pending")


def added_beliefs(beliefs: DataFrame, new: DataFrame) -> DataFrame:
    """Beliefs (id, content, confidence, source, timestamp) with new ones (content, confidence, source, timestamp), whose ids follow content and source, so a
    belief that comes again is the one that is there. Of new ones that are alike the first counts, then the least confident. Confidences are 0 to 1."""
    name = F.concat(F.lit("belief-"), F.substring(F.sha2(F.concat_ws("\x00", "source", "content"), 256), 1, 32))
    rows = new.where("content is not null").withColumn("confidence", F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)))
    once = rows.select(name.alias("id"), F.struct("timestamp", "confidence", "content", "source").alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    rows = once.select("id", "r.content", "r.confidence", "r.source", "r.timestamp")
    return beliefs.unionByName(rows.join(beliefs.select("id"), "id", "left_anti").select(*beliefs.columns))


def concept_summary(rows: DataFrame) -> DataFrame:
    """A group's summary: up to seven concepts in order, mean salience, first gist. Concepts are explode-distinct
    before they meet, so a group sends at most its distinct ones."""
    one = rows.groupBy("topic").agg(F.avg("salience").alias("salience"), F.min_by("gist", "id").alias("gist"))
    first = rows.select("topic", "id", F.posexplode("concepts").alias("i", "concept")).groupBy("topic", "concept").agg(F.min(F.struct("id", "i")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy("at", "concept"))
    seven = first.withColumn("r", rank).where("r <= 7").groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "concept"))), lambda x: x["concept"]).alias("concepts"))
    return one.join(seven, "topic", "left")
