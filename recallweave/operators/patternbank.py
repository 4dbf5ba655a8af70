"""Patterns learned from trajectories: centres that new trajectories move, kept as versions of a table.

A trajectory is a vector and the quality of what came of it. `bootstrap` finds the first centres in a bounded sample; `record` is one mini-batch step: each
task assigns its rows to the nearest centre and sums them by centre, Spark adds these sums, and the next version of the state is written from
them. A version belongs to a batch number, so a batch that comes twice, as in a restarted `foreachBatch`, counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import rename_new
from .neighbours import matrix

STATE = "centre int, vector array<double>, weight double, quality double, size bigint"
#: The centres go to every task, so their number is bounded.
MOST_CENTRES = 4096


def usable(trajectories: DataFrame, dim: int | None = None, key: str | None = None) -> DataFrame:
    """vector, quality, weight (and `key`, as text) of what can be learned from: no nulls, no NaN, no infinite or missing parts, the given length. A weight
    is 1 where the rows bring none, else it must be above 0."""
    weight = F.col("weight").cast("double") if "weight" in trajectories.columns else F.lit(1.0)
    named = [F.col(key).cast("string").alias("key")] if key else []
    rows = trajectories.select(F.col("vector").cast("array<double>").alias("vector"), F.col("quality").cast("double").alias("quality"), weight.alias("weight"), *named)
    sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # false for NaN, which counts as the largest
    rows = rows.where(sound & (F.abs("quality") < float("inf")) & (F.col("weight") > 0) & (F.col("weight") < float("inf")))
    return rows.where(F.size("vector") == dim if dim is not None else F.size("vector") > 0)


def nearest(x: np.ndarray, centres: np.ndarray, cells: int = 4_000_000) -> np.ndarray:
    """The row of the nearest centre; of equal ones the first. At most about `cells` distances at a time."""
    norms, block = (centres**2).sum(1)[None], max(1, cells // len(centres))
    return np.concatenate([np.argmin(norms - 2 * x[i : i + block] @ centres.T, axis=1) for i in range(0, len(x), block)])


def sums(trajectories: DataFrame, centres: np.ndarray) -> DataFrame:
    """centre, s (array of sums), w, qw, n: what all usable rows add to the centre nearest to them. A task sends one row a centre."""
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 3))  # sums of parts, weights, weighted qualities, rows
        for batch in batches:
            if batch.num_rows:
                x, quality, weight = matrix(batch.column(0)), np.asarray(batch.column(1))[:, None], np.asarray(batch.column(2))[:, None]
                at = nearest(x, centres)
                order = np.argsort(at, kind="stable")
                hit, start = np.unique(at[order], return_index=True)
                total[hit] += np.add.reduceat(np.hstack([x * weight, weight, weight * quality, np.ones_like(weight)])[order], start, axis=0)
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["centre", "t"])

    parts = trajectories.mapInArrow(run, "centre int, t array<double>")
    numbers = parts.select("centre", F.posexplode("t")).groupBy("centre", "pos").agg(F.sum("col").alias("x"))
    whole = numbers.groupBy("centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("t"))  # dim + 3 numbers
    return whole.select("centre", F.slice("t", 1, dim).alias("s"), F.get("t", F.lit(dim)).alias("w"), F.get("t", F.lit(dim + 1)).alias("qw"), F.get("t", F.lit(dim + 2)).cast("bigint").alias("n"))


def moved(state: DataFrame, added: DataFrame, keep: float = 1.0) -> DataFrame:
    """The state after a batch's sums: a centre is the mean of all it has seen, what came before weighted by `keep`. A centre that gets nothing stays."""
    old = F.col("weight") * keep
    now = old + F.col("w")
    vector = F.zip_with("vector", "s", lambda a, b: (a * old + b) / now)
    got = F.col("w").isNotNull()
    return state.join(added, "centre", "left").select(
        "centre", F.when(got, vector).otherwise(F.col("vector")).alias("vector"), F.when(got, now).otherwise(F.col("weight")).alias("weight"),
        F.when(got, (F.col("quality") * old + F.col("qw")) / now).otherwise(F.col("quality")).alias("quality"), (F.col("size") + F.coalesce("n", F.lit(0))).cast("bigint").alias("size"),
    )


class PatternBank:
    """The bank in a folder that driver and executors share. `k` centres at most, `keep` as in `moved`."""

    def __init__(self, spark: SparkSession, folder: str, k: int = 100, keep: float = 1.0):
        if not 0 < k <= MOST_CENTRES:
            raise ValueError(f"k is 1 to {MOST_CENTRES}")
        self.spark, self.folder, self.k, self.keep = spark, folder.rstrip("/"), k, keep

    def versions(self) -> list[int]:
        """The batches that the state has taken, in order; 0 is the bootstrap."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def state(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if version is None and not found:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.folder}/state/{found[-1] if version is None else version:012d}")

    def _place(self, state: DataFrame, version: int) -> None:
        aside = f"{self.folder}/aside-{uuid.uuid4().hex}"
        state.coalesce(1).write.parquet(aside)  # at most MOST_CENTRES rows
        rename_new(self.spark, aside, f"{self.folder}/state/{version:012d}")

    def bootstrap(self, trajectories: DataFrame, key: str, most: int | None = 5000, rounds: int = 5, spread: bool = True) -> None:
        """First centres, from about `most` rows that a hash of their key chooses (all, if there are fewer, or without `most`; `spread` needs it): distinct vectors, the first k by the hash, or with
        `spread` each drawn in proportion to its squared distance from those before, on the driver, which holds the sample. Then `rounds` passes over the sample set
        centres to the means of their rows. The first row's length by the hash is the bank's. Centres begin without weight, so `record` counts each trajectory once.
        Without usable rows the bank has no centres. A bank that has begun stays as it is."""
        if self.versions():
            return
        if spread and most is None:
            raise ValueError("the driver holds the sample that is spread, so it needs a bound")
        h = F.conv(F.substring(F.md5("key"), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
        rows = usable(trajectories, None, key).withColumn("h", h)
        n = rows.count() if most is not None else 0
        sample = rows.where(F.col("h") < most / n) if most is not None and n > most else rows
        distinct = sample.groupBy("vector").agg(F.min(F.struct("h", "key")).alias("o"))
        first = [r.vector for r in distinct.orderBy("o").select("vector").limit(2 * most if spread else self.k).collect()]
        x = np.array([v for v in first if len(v) == len(first[0])], dtype=float)
        centres = self._spread(x) if spread and len(x) else x[: self.k]
        for _ in range(rounds if len(centres) else 0):
            for r in sums(usable(sample, centres.shape[1]), centres).collect():  # at most MOST_CENTRES rows
                centres[r.centre] = np.asarray(r.s) / r.w
        self._place(self.spark.createDataFrame([(i, [float(v) for v in c], 0.0, 0.0, 0) for i, c in enumerate(centres)], STATE), 0)

    def _spread(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(42)
        at = [0]
        far = ((x - x[0]) ** 2).sum(1)
        while len(at) < min(self.k, len(x)) and far.sum() > 0:
            at.append(int(np.searchsorted(np.cumsum(far), rng.random() * far.sum(), side="right").clip(0, len(x) - 1)))
            far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
        return x[at].copy()

    def record(self, trajectories: DataFrame, batch: int) -> bool:
        """One step with a batch of trajectories (vector, quality, perhaps weight), by a batch number above 0 that grows; false, and nothing changes, where
        the state has taken that number already. Without a bootstrap there are no centres, which is an error; rows that `usable` leaves out count nothing."""
        found = self.versions()
        if not found:
            raise ValueError("bootstrap the bank first")
        if batch <= found[-1]:
            return False
        before = self.state()
        rows = before.orderBy("centre").collect()  # at most MOST_CENTRES
        if not rows:
            self._place(before, batch)
            return True
        centres = np.array([r.vector for r in rows])
        self._place(moved(before, sums(usable(trajectories, centres.shape[1]), centres), self.keep), batch)
        return True

    def patterns(self, least_quality: float = 0.3) -> DataFrame:
        """id, vector, quality, size of the centres that hold trajectories of at least that mean quality: what is exported."""
        kept = self.state().where((F.col("size") > 0) & (F.col("quality") >= least_quality))
        return kept.select(F.concat(F.lit("pattern-"), "centre").alias("id"), "vector", "quality", "size")

    def restore(self, patterns: DataFrame) -> None:
        """Begin with exported patterns: each is a centre that weighs as much as the trajectories it came from. Only for an empty bank; more than k rows are an error."""
        if self.versions():
            raise ValueError("the bank isn't empty")
        number = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
        rows = patterns.select(number.alias("centre"), F.col("vector").cast("array<double>").alias("vector"), F.col("size").cast("double").alias("weight"), F.col("quality").cast("double").alias("quality"), F.col("size").cast("bigint").alias("size"))
        if rows.limit(self.k + 1).count() > self.k:
            raise ValueError("more patterns than k")
        self._place(rows, 0)
