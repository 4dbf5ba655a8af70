"""Learning over tables: clusters of patterns, Q-values, weighted samples, codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patterns(trajectories: DataFrame, k: int = 10, least_quality: float = 0.3, seed: int = 42) -> DataFrame:
    """Clusters of trajectory vectors: centroid, mean quality and size; those under the least quality go."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = trajectories.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=15).fit(ready)
    sized = model.transform(ready).groupBy("prediction").agg(F.avg("quality").alias("quality"), F.count("*").alias("size"))
    centres = trajectories.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, vector array<double>")
    return sized.join(centres, "prediction").where(F.col("quality") >= least_quality).select(F.concat(F.lit("pattern-"), "prediction").alias("id"), "vector", "quality", "size")


def q_update(q: DataFrame, experiences: DataFrame, rate: float = 0.1, discount: float = 0.95) -> DataFrame:
    """One synchronous temporal-difference step: q (state, action, value) with experiences (state, action, reward,
    next_state, done). A pair's targets are averaged, so the result doesn't depend on any order."""
    best = q.groupBy(F.col("state").alias("next_state")).agg(F.max("value").alias("best"))
    target = F.col("reward") + discount * F.when(F.col("done"), 0.0).otherwise(F.coalesce("best", F.lit(0.0)))
    targets = experiences.join(best, "next_state", "left").groupBy("state", "action").agg(F.avg(target).alias("target"), F.count("*").alias("n"))
    joined = q.join(targets, ["state", "action"], "full")
    old = F.coalesce("value", F.lit(0.0))
    return joined.select("state", "action", F.when(F.col("target").isNull(), old).otherwise(old + rate * (F.col("target") - old)).alias("value"), F.coalesce("n", F.lit(0)).alias("visits"))


def greedy(q: DataFrame) -> DataFrame:
    return q.groupBy("state").agg(F.max_by("action", F.struct("value", -F.col("action"))).alias("action"))


def adapted_exploration(rate: Column, trend: Column) -> Column:
    return F.when(trend < -0.05, F.least(rate * 1.1, F.lit(0.3))).when(trend > 0.05, F.greatest(rate * 0.95, F.lit(0.05))).otherwise(rate)


def trend(rows: DataFrame, value: str, index: str) -> DataFrame:
    """The slope of value on index; 0 for fewer than two rows or one index."""
    return rows.agg(F.coalesce(F.regr_slope(F.col(value).cast("double"), F.col(index).cast("double")), F.lit(0.0)).alias("trend"))


def weighted_sample(rows: DataFrame, n: int, weight: str, key: str, seed: int = 1) -> DataFrame:
    """n rows without replacement, each chosen in proportion to its weight, by exponential keys hashed from the id."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(16**13))
    return rows.where(F.col(weight) > 0).withColumn("__k", -F.log(u) / F.col(weight)).orderBy("__k", key).limit(n).drop("__k")


def order_parameter(phases: DataFrame, phase: str = "phase") -> DataFrame:
    """Synchrony of oscillators, 0 to 1."""
    return phases.agg(F.coalesce(F.sqrt(F.pow(F.avg(F.cos(phase)), 2) + F.pow(F.avg(F.sin(phase)), 2)), F.lit(0.0)).alias("synchrony"))


def planes(dim: int, wide: int, seed: int) -> np.ndarray:
    """dim rows of `wide` numbers, uniform with mean 0 and variance 1 / dim, each by a hash of its place and the seed, so tasks and other engines agree on them."""
    i, j = np.arange(dim, dtype=np.uint64)[:, None], np.arange(wide, dtype=np.uint64)[None, :]
    m = i * np.uint64(0x9E3779B97F4A7C15) + j * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed * 0x165667B19E3779F9 % 2**64)
    m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    unit = ((m ^ (m >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return (unit * 2 - 1) * np.sqrt(3 / dim)


def sparse_novelty(rows: DataFrame, vector: str = "vector", expand: int = 4, k: int = 10, seed: int = 42) -> DataFrame:
    """rows with `code`, the k strongest of expand * dim random projections, and `novelty`, min(1, their energy / k)."""

    def run(batches):
        cast = None
        for batch in batches:
            x = np.asarray(batch.column(batch.schema.get_field_index(vector)).cast(pa.list_(pa.float64())).flatten()).reshape(batch.num_rows, -1)
            if cast is None:
                cast = planes(x.shape[1], x.shape[1] * expand, seed)
            y = x @ cast
            top = np.sort(np.argsort(-y, axis=1, kind="stable")[:, :k], axis=1)
            energy = np.take_along_axis(np.maximum(y, 0), top, axis=1).sum(1)
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * top.shape[1]), pa.array(top.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, code, pa.array(np.minimum(1.0, energy / k))], names=[*batch.schema.names, "code", "novelty"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, code array<int>, novelty double")


def quantized(v: Column, access_share: Column) -> Column:
    """A vector rounded by how often it is used: as it is when hot, to 1/127 of its largest part when warm, to 1/7 when cold."""
    top = F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(1e-12))
    levels = F.when(access_share > 0.8, 0).when(access_share > 0.4, 127).otherwise(7)
    # Adding 0.0 leaves no negative zero.
    return F.when(levels == 0, v).otherwise(F.transform(v, lambda x: F.round(x / top * levels) / levels * top + F.lit(0.0)))


def residual_gate(rows: DataFrame, by: list[str], order: list, value: str, threshold: float = 0.1) -> DataFrame:
    """Rows that differ from the one before by more than a part of it: what prediction leaves over."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    known = rows.withColumn("expected", F.coalesce(before, F.lit(0.0))).withColumn("residual", F.abs(F.col(value) - F.col("expected")))
    return known.where(F.col("residual") > threshold * F.greatest(F.abs("expected"), F.lit(1e-9))).drop("expected")
