"""A re-ranker that learns from the query log: a small network over a query, a candidate and four features.

Its hidden layer reads both vectors; its output adds four features (index score, accesses, recency, wanted type) and ranks by
`0.7 * index score + 0.3 * sigmoid(output)`. Training takes pairs from the log (the selected result and each other one that was shown; the selected one's vector
stands for the query) and a margin ranking loss. A step is one pass: each task sums the exact gradients of both layers over its
pairs, Spark adds the tasks' sums, and only these, as many numbers as there are weights, reach the driver. Weights are a table with a version for
each step, so training goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from ..sources.store import rename_new
from .neighbours import matrix

FEATURES = ("f_index", "f_access", "f_recency", "f_type")
MARGIN, SHOWN, SELECTED = 0.1, 0.5, 1.0  # the index scores of what was shown and what was selected
WEIGHTS = "name string, i int, h int, value double"


@dataclass
class Network:
    w1: np.ndarray  # twice the vector's length x hidden
    b1: np.ndarray
    w2: np.ndarray  # hidden and the features
    b2: float

    @classmethod
    def initial(cls, dim: int, hidden: int = 128) -> Network:
        """Small weights that a rule gives, so that every run and every engine begins alike: sines of their numbers."""
        n = np.arange(2 * dim * hidden).reshape(2 * dim, hidden)
        return cls(0.1 * np.sin(1.0 + n), np.zeros(hidden), 0.1 * np.sin(1.0 + np.arange(hidden + len(FEATURES))), 0.0)

    def _parts(self) -> list[tuple[str, np.ndarray]]:
        return [("w1", self.w1), ("b1", self.b1[None]), ("w2", self.w2[None]), ("b2", np.array([[self.b2]]))]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for _, p in self._parts()])

    def with_flat(self, values: np.ndarray) -> Network:
        a, b, c = self.w1.size, self.w1.size + self.b1.size, self.w1.size + self.b1.size + self.w2.size
        return Network(values[:a].reshape(self.w1.shape), values[a:b], values[b:c], float(values[c]))

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(name, i, h, float(v)) for name, p in self._parts() for (i, h), v in np.ndenumerate(p)], WEIGHTS)

    @classmethod
    def from_table(cls, table: DataFrame) -> Network:
        rows = table.collect()  # as many as there are weights
        def part(name: str) -> np.ndarray:
            own = [r for r in rows if r.name == name]
            out = np.zeros((max(r.i for r in own) + 1, max(r.h for r in own) + 1))
            for r in own:
                out[r.i, r.h] = r.value
            return out
        return cls(part("w1"), part("b1")[0], part("w2")[0], float(part("b2")[0, 0]))

    def _hidden(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.maximum(np.concatenate([q, c], axis=1) @ self.w1 + self.b1, 0)

    def output(self, q: np.ndarray, c: np.ndarray, features: np.ndarray) -> np.ndarray:
        return np.concatenate([self._hidden(q, c), features], axis=1) @ self.w2 + self.b2

    def gradients(self, q: np.ndarray, other: np.ndarray, f_selected: np.ndarray, f_other: np.ndarray) -> tuple[float, np.ndarray]:
        """(sum of the losses, sum of their gradients, flat) of pairs in which q's own row was selected before `other`."""
        a, b = self._hidden(q, q), self._hidden(q, other)
        loss = np.maximum(0, MARGIN - np.concatenate([a, f_selected], axis=1) @ self.w2 + np.concatenate([b, f_other], axis=1) @ self.w2)
        on = (loss > 0)[:, None]
        back = self.w2[: len(self.b1)]
        da, db = on * (a > 0) * back, on * (b > 0) * back
        w1 = np.concatenate([q, other], axis=1).T @ db - np.concatenate([q, q], axis=1).T @ da
        w2 = np.concatenate([(on * (b - a)).sum(0), (on * (f_other - f_selected)).sum(0)])
        return float(loss.sum()), np.concatenate([w1.ravel(), (db - da).sum(0), w2, [0.0]])


def features(rows: DataFrame, index: float | None, as_of_ms: int, wanted_type: str) -> DataFrame:
    """rows with FEATURES; `index` is the index score where rows have no similarity of their own."""
    score = F.col("similarity") if index is None else F.lit(index)
    return rows.withColumns({"f_index": score.cast("double"), "f_access": F.log1p("access_count") / 10, "f_recency": F.exp((F.col("timestamp") - F.lit(as_of_ms)) / 86_400_000), "f_type": F.when(F.lower("memory_type") == wanted_type.lower(), 1.0).otherwise(0.0)})


def pairs(log: DataFrame, memories: DataFrame, as_of_ms: int, wanted_type: str) -> DataFrame:
    """selected, other, q, v, f_selected, f_other for each log entry (result_ids, selected_id) and each result of it that wasn't selected. Entries
    without a selection, and memories that are gone, give no pair."""
    shown = log.where("selected_id is not null").select(F.col("selected_id").alias("selected"), F.explode("result_ids").alias("other")).where("other <> selected")
    known = lambda index, vector, f: features(memories, index, as_of_ms, wanted_type).select("id", F.col("vector").cast("array<double>").alias(vector), F.array(*FEATURES).alias(f))
    both = shown.join(known(SELECTED, "q", "f_selected").withColumnRenamed("id", "selected"), "selected").join(known(SHOWN, "v", "f_other").withColumnRenamed("id", "other"), "other")
    return both.select("selected", "other", "q", "v", "f_selected", "f_other")


def gradient(rows: DataFrame, net: Network) -> tuple[float, int, np.ndarray]:
    """(sum of losses, pairs, sum of gradients) over pairs; each task sends one row."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, total = 0.0, 0, np.zeros(len(sent.value.flat()))
        for batch in batches:
            if batch.num_rows:
                more, g = sent.value.gradients(*(matrix(c) for c in batch.columns))
                loss, n, total = loss + more, n + batch.num_rows, total + g
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([total.tolist()])], names=["loss", "n", "g"])

    sums = rows.select("q", "v", "f_selected", "f_other").mapInArrow(run, "loss double, n long, g array<double>")
    each = sums.select(F.posexplode(F.concat(F.array("loss", F.col("n").cast("double")), "g")).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    out = np.zeros(2 + len(net.flat()))
    for r in each.collect():  # as many as there are weights
        out[r["at"]] = r.x
    return float(out[0]), int(out[1]), out[2:]


def step(rows: DataFrame, net: Network, rate: float) -> tuple[Network, float]:
    """The network after one step over all pairs, and the mean loss before it."""
    loss, n, g = gradient(rows, net)
    return (net.with_flat(net.flat() - rate / n * g), loss / n) if n else (net, 0.0)


class Training:
    """Steps whose weights are versions below a shared folder (`step=N`); another one on the same folder goes on from the last."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def last(self) -> int | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n.split("=")[1]) for n in names if n.startswith("step=")), default=None)

    def weights(self) -> Network:
        return Network.from_table(self.spark.read.schema(WEIGHTS).parquet(f"{self.folder}/step={self.last()}"))

    def _keep(self, net: Network, n: int) -> None:
        net.to_table(self.spark).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/_aside")
        rename_new(self.spark, f"{self.folder}/_aside", f"{self.folder}/step={n}")

    def run(self, rows: DataFrame, steps: int, rate: float = 0.01, hidden: int = 128) -> list[float]:
        """Go on until `steps` steps are there; gives the mean losses before each step taken now."""
        rows = written(rows, "pairs")
        losses: list[float] = []
        if self.last() is None:
            first = rows.select(F.size("q")).first()
            if first is None:
                return losses
            self._keep(Network.initial(first[0], hidden), 0)
        net = self.weights()
        for n in range(self.last() + 1, steps + 1):
            net, loss = step(rows, net, rate)
            self._keep(net, n)
            losses.append(loss)
        return losses


def rerank(hits: DataFrame, query: DataFrame, net: Network, weight: float = 0.7) -> DataFrame:
    """id, similarity, score of hits (id, vector, similarity, FEATURES) for a one-row query (q)."""
    sent = hits.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = sent.value.output(*(matrix(batch.column(k)) for k in (3, 1, 4)))
                score = weight * batch.column(2).to_numpy() + (1 - weight) / (1 + np.exp(-out))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], names=["id", "similarity", "score"])

    rows = hits.crossJoin(F.broadcast(query)).select("id", F.col("vector").cast("array<double>"), "similarity", "q", F.array(*FEATURES).alias("f"))
    return rows.mapInArrow(run, "id string, similarity double, score double")
