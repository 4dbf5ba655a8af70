"""Order statistics and numbering of groups of any size, without a window over a group.

A wanted index of a group lies in one of a few ranges of its values. Each round cuts the open range at approximate quantiles, counts
what falls between the cuts, and goes on with the range that holds the index, until that holds one value or few rows. Counts and quantiles are
partial aggregates, so a group that holds most rows is read by all tasks and meets as sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

CUTS, FEW = 32, 4096


def at_index(rows: DataFrame, group: str, value: str, wanted: dict[str, Callable[[Column], Column]], few: int = FEW) -> DataFrame:
    """group and, for each name in `wanted`, the value at that index (a function of the number of values, from 0) of the group's values in ascending order.
    Nulls are not counted; a group without values has a row of nulls, and so has an index that isn't there."""
    own = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    totals = own.groupBy("g").agg(F.count("v").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("long").alias("i")) for name, f in wanted.items()]))
    none = F.lit(None).cast("double")
    targets = totals.select("g", "n", each.alias("x")).select("g", "x.name", "x.i", F.col("n").alias("rows"), none.alias("lo"), none.alias("hi"), none.alias("found"))
    targets = written(targets.where("i between 0 and rows - 1"), "targets")
    open_ = (F.col("found").isNull()) & (F.col("rows") > few)
    while targets.where(open_).limit(1).count():
        inside = own.where("v is not null").join(targets.where(open_).select("g", "name", "i", "lo", "hi"), own["g"].eqNullSafe(targets["g"])).drop(targets["g"])
        inside = inside.where((F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") <= F.col("hi")))).drop("lo", "hi")
        cuts = inside.groupBy("g", "name").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", [k / CUTS for k in range(1, CUTS)], 1000))).alias("cuts"))
        cut = inside.join(cuts.withColumnsRenamed({"g": "cg", "name": "cname"}), F.col("g").eqNullSafe(F.col("cg")) & (F.col("name") == F.col("cname")))
        # Values between two cuts and those that equal one are parts of their own, so a value that most rows have doesn't hold others back.
        place = 2 * F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")
        parts = cut.groupBy("g", "name", "i", "cuts", place.alias("part")).agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("m").over(Window.partitionBy("g", "name").orderBy("part"))  # as many rows as there are cuts
        hit = parts.withColumn("upto", upto).where((F.col("i") < F.col("upto")) & (F.col("i") >= F.col("upto") - F.col("m")))
        below = F.when(F.col("part") > 1, F.get("cuts", F.floor(F.col("part") / 2).cast("int") - 1))
        new = hit.select("g", "name", (F.col("i") - F.col("upto") + F.col("m")).alias("i"), F.col("m").alias("rows"), below.alias("lo"), F.col("most").alias("hi"), F.when(F.col("least") == F.col("most"), F.col("least")).alias("found"))
        old = targets.where(open_).select(F.col("g").alias("og"), F.col("name").alias("oname"), F.col("lo").alias("olo"))
        new = new.join(old, F.col("g").eqNullSafe(F.col("og")) & (F.col("name") == F.col("oname"))).withColumn("lo", F.coalesce("lo", "olo")).drop("og", "oname", "olo")
        targets = written(targets.where(~open_).unionByName(new), "targets")
    rest = targets.where("found is null").select(F.col("g").alias("tg"), "name", "i", "lo", "hi")
    few_rows = own.where("v is not null").join(rest, F.col("g").eqNullSafe(F.col("tg"))).where((F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") <= F.col("hi"))))
    at = F.row_number().over(Window.partitionBy("g", "name").orderBy("v")) - 1  # at most `few` rows
    last = few_rows.withColumn("at", at).where(F.col("at") == F.col("i")).select("g", "name", F.col("v").alias("found"))
    both = targets.where("found is not null").select("g", "name", "found").unionByName(last)
    wide = both.groupBy("g").agg(*[F.max(F.when(F.col("name") == n, F.col("found"))).alias(n) for n in wanted])
    out = totals.select(F.col("g").alias("tg")).join(wide, F.col("tg").eqNullSafe(F.col("g")), "left")
    return out.select(F.col("tg").alias(group), *wanted)


def numbered(rows: DataFrame, order: list[Column], by: list[str], name: str) -> DataFrame:
    """rows with their number in their group (from 1) in the order, which should have no ties. Rows are dealt into ranges of (group, order) and
    numbered there; what comes before a range, and where a group begins, are known from one count for each range and one least place for each group."""
    keys = [F.col(b) for b in by]
    sorted_rows = written(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    counts = sorted_rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row for each range
    before, upto = [], 0
    for r in counts:
        before.append((r.p, upto))
        upto += r.n
    offsets = rows.sparkSession.createDataFrame(before, "__p long, __before long")
    placed = sorted_rows.join(F.broadcast(offsets), part == F.col("__p")).withColumn("__place", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    first = placed.groupBy(*[F.col(b).alias(f"__g{i}") for i, b in enumerate(by)]).agg(F.min("__place").alias("__first"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__g{i}"))
    joined = placed.join(first, same)
    return joined.select(*rows.columns, (F.col("__place") - F.col("__first") + 1).alias(name))
