"""Mixing sources to target weights by Poisson replication.

A document's number of copies is drawn by inverting the Poisson distribution with its source's mean
repetition rate at a uniform number hashed from seed, key, text and, among equal rows, an ordinal; so it depends on nothing but these, whatever
the partitioning, and a lost task draws the same again. The copies are shuffled globally by a hash of the same and the copy's number, so
neither a key nor a row that is repeated very often meets in one partition.

A source's rate is (total mass) * (its target weight) / (its mass); mass is characters. Weights are given by
source, or else follow mass ** `exponent` (temperature sampling).

Edge cases: sources may be null (a source of their own); a source whose texts are all empty has rate 1; a
source without a weight, where weights are given, has rate 0. Rows that share a key (or have none) draw apart, and so do equal rows.
Where docs has a column named as one of the new ones, the new one's name gets underscores at its end until it is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTES_A_FILE, in_files, settle

#: Larger rates are drawn as sums of independent parts of at most this mean, so exp(-rate) stays exact.
PART = 16.0
#: The table of rates is broadcast up to so many sources.
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    hexadecimal = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])), 1, 13)
    return F.conv(hexadecimal, 16, 10).cast("double") / F.lit(float(16**13))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, text: str = "text", source: str = "source") -> DataFrame:
    """source, mass (characters), bytes, rate: the mean number of copies of a document of that source."""
    mass = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("mass"), F.sum(F.coalesce(F.octet_length(text), F.lit(0))).alias("bytes"))
    if weights is None:
        weight = F.pow("mass", F.lit(exponent))
    else:
        weight = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
    mass = mass.withColumn("weight", weight)
    whole = mass.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))  # one row
    rate = F.when(F.col("mass") == 0, 1.0).when(F.col("all_weight") == 0, 0.0).otherwise(F.col("all_mass") * F.col("weight") / F.col("all_weight") / F.col("mass"))
    return mass.crossJoin(F.broadcast(whole)).select("source", "mass", "bytes", rate.alias("rate"))


def poisson_table(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until it is 1 to double precision."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda a, k: F.struct((a["p"] * rate / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["c"])


def _ordinals(docs: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """docs and the ordinal of each row among equal rows. Only rows whose key and text repeat are counted, and reduced before they are shuffled."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.withColumn("__rw_hash", F.xxhash64(key, text))
    again = hashed.groupBy("__rw_hash").count().where("count > 1").select("__rw_hash")
    if not again.limit(1).count():
        return docs.withColumn(name, F.lit(1).cast("long"))
    again = settle(again, "again", docs.count())
    single = hashed.join(again, "__rw_hash", "left_anti").select(*columns, F.lit(1).cast("long").alias(name))
    multiple = hashed.join(again, "__rw_hash", "left_semi").groupBy(*columns).agg(F.count("*").alias("__rw_n"))
    return single.unionByName(multiple.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rw_n"))).alias(name)))


def replicate(
    docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source", copy: str = "copy", copies: str = "copies"
) -> DataFrame:
    """Every column of docs, `copy` (from 1) and `copies`, one row for each drawn copy, in a shuffled order.
    The table of rates has a row for each source; it is written first, so its size is known."""
    while copy in docs.columns:
        copy += "_"
    while copies in [*docs.columns, copy]:
        copies += "_"
    columns = [F.col(f"`{c}`") for c in docs.columns]
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    table = rates(docs, weights, exponent, text, source).select(F.col("source").alias("__rw_source"), (F.col("bytes") * F.col("rate")).alias("__rw_bytes"), parts.alias("__rw_parts"), poisson_table(F.col("rate") / parts).alias("__rw_table"))
    table = settle(table, "rates")
    # A checked size: beyond it Spark joins by source, and adaptive execution splits a hot one.
    sources, size = table.agg(F.count("*"), F.sum("__rw_bytes")).first()
    small = sources <= BROADCAST_SOURCES
    own = _ordinals(docs, key, text, "__rw_ordinal").withColumn("__rw_text", F.md5(F.coalesce(F.col(text), F.lit(""))))
    joined = own.join(F.broadcast(table) if small else table, F.col(source).eqNullSafe(F.col("__rw_source")))
    numbers = F.transform(F.sequence(F.lit(1), F.col("__rw_parts")), lambda i: uniform(str(seed), F.col(key), F.col("__rw_text"), F.col("__rw_ordinal"), i))
    drawn = F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter("__rw_table", lambda c: c <= u)))
    counted = joined.select(*columns, "__rw_text", "__rw_ordinal", drawn.alias("__rw_copies")).where("__rw_copies > 0")
    spread = counted.select("*", F.explode(F.sequence(F.lit(1), F.col("__rw_copies"))).alias("__rw_copy"))
    order = F.md5(F.concat_ws("|", F.lit(f"{seed} order"), F.col(key).cast("string"), "__rw_text", F.col("__rw_ordinal").cast("string"), F.col("__rw_copy").cast("string")))
    mixed = spread.withColumn("__rw_order", order).repartition("__rw_order").sortWithinPartitions("__rw_order")
    return in_files(mixed, int(size or 0), BYTES_A_FILE).select(*columns, F.col("__rw_copy").alias(copy), F.col("__rw_copies").alias(copies))
