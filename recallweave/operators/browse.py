"""Browsing: items of several kinds in one shape, filtered and sorted; topic files; the policy of a maintenance cycle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORT_FIELDS = ("timestamp", "importance", "access_count", "type", "name")


def items(df: DataFrame, kind: str, key: str, searched: list[str], **fields: str) -> DataFrame:
    """kind, key, the sort fields (0 or empty where this kind has none) and the texts that a filter looks through."""
    number = lambda f: F.col(fields[f]) if f in fields else F.lit(0)
    word = lambda f: F.coalesce(F.col(fields[f]), F.lit("")) if f in fields else F.lit("")
    return df.select(
        F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), number("timestamp").cast("bigint").alias("timestamp"), number("importance").cast("double").alias("importance"),
        number("access_count").cast("bigint").alias("access_count"), word("type").alias("type"), word("name").alias("name"), F.array(*searched).alias("searched"),
    )


def browse(kinds: list[DataFrame], contains: str = "", by: str = "timestamp", descending: bool = True, limit: int = 100) -> DataFrame:
    """The first items by one of SORT_FIELDS, ties by kind and key, among those with `contains` in a searched text, whatever its case."""
    if by not in SORT_FIELDS:
        raise ValueError(f"unknown sort field {by}")
    both = reduce(DataFrame.unionByName, kinds)
    if contains:
        both = both.where(F.exists("searched", lambda x: F.coalesce(F.contains(F.lower(x), F.lit(contains.lower())), F.lit(False))))
    return both.drop("searched").orderBy(F.desc(by) if descending else F.asc(by), "kind", "key").limit(limit)


def topics(files: DataFrame, topic: str, body: str, modified: str) -> DataFrame:
    """By topic: the memories written in its files (lines that begin with `### `) and the latest change."""
    entries = F.size(F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda line: F.startswith(line, F.lit("### "))))
    return files.groupBy(F.col(topic).alias("topic")).agg(F.sum(entries).cast("bigint").alias("memories"), F.max(modified).alias("modified"))


def learning_trend(patterns: Column, sync: Column, dropped: Column) -> Column:
    return F.when((patterns > 10) & (sync > 0.5), "improving").when(dropped > 0, "declining").otherwise("stable")


def introspection(memories: DataFrame, thoughts: DataFrame, goals: DataFrame, trajectories: DataFrame, patterns: DataFrame, synchrony: DataFrame, buffer: int = 10_000) -> DataFrame:
    """One row: memories, thoughts, experiences (trajectories that the buffer still holds), active_goals (active or pending), avg_reward (the synchrony, one row) and the trend, in which
    trajectories that the buffer has dropped count against patterns stored."""
    one = lambda df, **aggs: df.agg(*[a.alias(n) for n, a in aggs.items()])
    out = one(memories, memories=F.count("*"))
    parts = [
        one(thoughts, thoughts=F.count("*")), one(trajectories, experiences=F.least(F.count("*"), F.lit(buffer)), dropped=F.greatest(F.count("*") - buffer, F.lit(0))),
        one(goals, active_goals=F.count_if(F.col("status").isin("Active", "Pending"))), one(patterns, patterns=F.count("*")), synchrony.select(F.col("synchrony").alias("avg_reward")),
    ]
    for part in parts:
        out = out.crossJoin(F.broadcast(part))  # one row each
    trend = learning_trend(F.col("patterns"), F.col("avg_reward"), F.col("dropped"))
    return out.select("memories", "thoughts", "experiences", "active_goals", "avg_reward", trend.alias("trend"))


def adaptations(dropped: Column, avg_decay: Column, stored: Column, capacity: Column, sync: Column) -> Column:
    """What a cycle has to do or report, in order."""
    due = [("learn", dropped > 0), ("consolidate", avg_decay > 0.5), ("near_capacity", (capacity > 0) & (stored > 0.8 * capacity)), ("synchronised", sync > 0.7)]
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in due]))


def softmax_policy(q: DataFrame, temperature: float = 1.0) -> DataFrame:
    """state, action, probability: each action's softmax share of its state's values; states have few actions."""
    listed = q.groupBy("state").agg(F.max("value").alias("top"), F.sort_array(F.collect_list(F.struct("action", "value"))).alias("actions"))
    weight = lambda x: F.exp((x["value"] - F.col("top")) / temperature)
    whole = F.aggregate("actions", F.lit(0.0), lambda total, x: total + weight(x))
    return listed.select("state", whole.alias("whole"), "top", F.explode("actions").alias("a")).select("state", "a.action", (F.exp((F.col("a.value") - F.col("top")) / temperature) / F.col("whole")).alias("probability"))
