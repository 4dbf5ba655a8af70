"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree splits a bounded sample by the hyperplane between two random points of a node, at the median of
its projections, down to leaves of about `LEAF` sample points; every vector is then routed to one leaf of each
tree. A query walks all trees through one priority queue: it descends to the leaf on its side of each
split and queues the far sides by their largest margin so far, then takes up the side with the least margin,
until the leaves that it has seen hold the wanted share of entries. Leaf candidates are ranked by their
exact distance. The share is found on the sample: the smallest that reaches the wanted recall
there against brute force, so clustered data are searched sparsely and shapeless data broadly.

Equal vectors are one entry with the smallest `k + 1` ids: a query needs no more of them, whatever their number.
Leaves meet queries in blocks bounded in both, and each block sends a query's best few when it is done.

Edge cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows
without an id or with another length than most; of rows that share an id the smallest vector counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, unit_hash
from .textkit import groups

TREES, LEAF, SAMPLE = 12, 96, 20_000
#: Rows of a leaf, and queries, that meet in one block.
ROWS, QUERIES = 8192, 4096
#: Vectors that one task writes.
VECTORS_A_FILE = 5000
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees: a plane with two children, or a leaf. Children < 0 are leaves ~child."""

    planes: np.ndarray  # (nodes, dimension), unit length
    offsets: np.ndarray
    children: np.ndarray  # (nodes, 2)
    roots: tuple[int, ...]
    leaves: int

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            open_ = np.flatnonzero(at >= 0)
            while len(open_):
                node = at[open_]
                side = np.einsum("ij,ij->i", x[open_], self.planes[node]) >= self.offsets[node]
                at[open_] = self.children[node, side.astype(int)]
                open_ = open_[at[open_] >= 0]
            out[:, t] = ~at
        return out

    def visit(self, x: np.ndarray) -> Iterator[int]:
        """Leaves of all trees in the order of the shared priority queue."""
        margin = (self.planes @ x - self.offsets).tolist() if len(self.planes) else []
        queue = [(0.0, t, root) for t, root in enumerate(self.roots)]
        order = len(queue)
        children = self.children.tolist()
        while queue:
            bound, _, node = heapq.heappop(queue)
            while node >= 0:
                m = margin[node]
                left, right = children[node]
                near, far = (right, left) if m >= 0 else (left, right)
                order += 1
                heapq.heappush(queue, (max(bound, abs(m)), order, far))
                node = near
            yield ~node


def grow(x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 3) -> Forest:
    rng = np.random.default_rng(seed)
    planes, offsets, children, leaves = [], [], [], 0

    def node(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(3):
                a, b = x[rng.choice(rows, 2, replace=False)]
                gap = a - b
                size = np.linalg.norm(gap)
                if size <= 0:
                    continue
                gap = gap / size
                cast = x[rows] @ gap
                middle = float(np.median(cast))
                side = cast >= middle
                if 0 < side.sum() < len(rows):
                    me = len(planes)
                    planes.append(gap)
                    offsets.append(middle)
                    children.append([0, 0])
                    children[me] = [node(rows[~side]), node(rows[side])]
                    return me
        leaves += 1
        return ~(leaves - 1)

    roots = tuple(node(np.arange(len(x))) for _ in range(trees))
    return Forest(np.array(planes).reshape(len(planes), x.shape[1]), np.array(offsets), np.array(children, int).reshape(-1, 2), roots, leaves)


def calibrate(forest: Forest, x: np.ndarray, k: int, recall: float, seed: int = 4, tests: int = 150) -> float:
    """The smallest share of entries, counted with repeats over trees, that finds `recall` of the k nearest."""
    rng = np.random.default_rng(seed)
    home = forest.route(x)
    members = [np.zeros(0, int)] * forest.leaves
    flat, row = home.reshape(-1), np.repeat(np.arange(len(x)), home.shape[1])
    order = np.argsort(flat, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(flat[order])) + 1) if len(order) else ():
        members[flat[part[0]]] = row[part]
    needed = []
    for i in rng.choice(len(x), min(tests, len(x)), replace=False):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        when = np.full(len(x), np.inf)
        seen = 0
        for leaf in forest.visit(x[i]):
            rows = members[leaf]
            seen += len(rows)
            fresh = rows[np.isinf(when[rows])]
            when[fresh] = seen
        needed.append(when[near] / (len(x) * len(forest.roots)))
    return float(np.quantile(np.concatenate(needed), recall)) if needed and len(x) > 1 else 1.0


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def usable_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array<double>) of the rows that take part; one row for each id."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are one number: adding 0.0 makes them equal in groups too.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (width[0] if width else -1)).groupBy("id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, queries, k: int = 10, key: str = "vec_id", vector: str = "embedding", recall: float = 0.97, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that the condition `queries` (on column `id`) picks, the k
    nearest of all other rows by Euclidean distance, ties to the smaller id. The forest and the share of
    leaves to visit come from at most about `sample` vectors (a bounded sample by a hash of the id)."""
    spark = vectors.sparkSession
    n = vectors.count()
    rows = settle(usable_vectors(vectors, key, vector), "vectors", n, VECTORS_A_FILE)
    # Salted first, so the copies of one very common vector don't meet in one task.
    salt = F.pmod(F.xxhash64("id"), F.lit(16))
    ranked = lambda w, df: df.withColumn("r", F.row_number().over(w.orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    few = ranked(Window.partitionBy("v"), ranked(Window.partitionBy("v", "salt"), rows.withColumn("salt", salt)))
    entries = settle(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("entry"), "ids", "v"), "entries", n, VECTORS_A_FILE)
    total = entries.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    x = _matrix(entries.where(unit_hash("entry", F.lit(29)) < sample / total).select("v").toArrow().column(0)) if total > 1 else np.zeros((0, 1))
    if not len(x):
        x = _matrix(entries.limit(1).select("v").toArrow().column(0))
    forest = grow(x, trees, leaf)
    share = min(1.0, calibrate(forest, x, k, recall))
    sent = spark.sparkContext.broadcast(forest)  # at most trees * 2 * sample / leaf planes

    def home(batches):
        for batch in batches:
            at = sent.value.route(_matrix(batch.column(1)))
            n, t = at.shape
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * t), pa.array(at.reshape(-1)))], names=["entry", "leaves"])

    homes = entries.select("entry", "v").mapInArrow(home, "entry long, leaves array<int>")
    placed = settle(homes.select("entry", F.explode("leaves").alias("leaf")), "leaves")
    size = dict(placed.groupBy("leaf").count().collect())  # one row for each leaf
    counts = spark.sparkContext.broadcast(np.array([size.get(i, 0) for i in range(forest.leaves)]))
    wanted = share * total * trees

    def probe(batches):
        for batch in batches:
            ids, leaves = [], []
            for i, v in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)), strict=True):
                seen = 0
                for leaf_ in sent.value.visit(v):
                    ids.append(i)
                    leaves.append(leaf_)
                    seen += counts.value[leaf_]
                    if seen >= wanted and seen >= k + 1:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(leaves, pa.int32())], names=["query", "leaf"])

    asked = settle(rows.where(queries), "queries", n, VECTORS_A_FILE)
    probes = settle(asked.repartition(F.col("id")).mapInArrow(probe, "query long, leaf int"), "probes")
    blocks = placed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / ROWS).cast("int").alias("nr"))
    asking = probes.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / QUERIES).cast("int").alias("nq"))
    shape = blocks.join(asking, "leaf")
    block = lambda a, b: F.xxhash64("leaf", a, b)
    mod = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q_rows = probes.join(shape, "leaf").select("leaf", "query", mod("query", "nq").alias("a"), upto("nr").alias("b")).select(block(F.col("a"), F.col("b")).alias("block"), F.lit(0).alias("kind"), F.col("query").alias("id")).join(asked, "id")
    e_rows = placed.join(shape, "leaf").select("leaf", "entry", mod("entry", "nr").alias("b"), upto("nq").alias("a")).select(block(F.col("a"), F.col("b")).alias("block"), F.lit(1).alias("kind"), F.col("entry").alias("id"))
    e_rows = e_rows.join(entries.select(F.col("entry").alias("id"), "v"), "id")
    met = q_rows.select("block", "kind", "id", "v").unionByName(e_rows.select("block", "kind", "id", "v")).repartition("block").sortWithinPartitions("block", "kind")
    best = met.mapInArrow(_rank(k + 1), "query long, entry long, d double")
    top = best.groupBy("query", "entry").agg(F.min("d").alias("d"))
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("d", "entry"))).where(F.col("r") <= k + 1)
    named = top.join(entries.select("entry", "ids"), "entry").select("query", "d", F.explode("ids").alias("vec_id")).where("query <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "vec_id"))
    return named.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", F.col("d").alias("score"))


def _rank(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of this block; the aggregate behind it merges blocks
            kind = np.asarray(rows.column("kind").combine_chunks())
            ids = np.asarray(rows.column("id").combine_chunks())
            x = _matrix(rows.column("v"))
            asks, holds = kind == 0, kind == 1
            q, e, qid, eid = x[asks], x[holds], ids[asks], ids[holds]
            if not len(q) or not len(e):
                continue
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                rough = (part**2).sum(1)[:, None] + (e**2).sum(1) - 2 * part @ e.T
                # Beyond rounding no exact distance among the k smallest can be missed.
                edge = np.partition(rough, min(k, len(e)) - 1, axis=1)[:, min(k, len(e)) - 1]
                for i, row in enumerate(rough):
                    near = np.flatnonzero(row <= edge[i] + 1e-9 * (1 + abs(edge[i])))
                    d = np.sqrt(((e[near] - part[i]) ** 2).sum(1))
                    have = best.get(int(qid[at + i]))
                    names = eid[near]
                    if have is not None:
                        d, names = np.concatenate([have[0], d]), np.concatenate([have[1], names])
                    names, first = np.unique(names, return_index=True)
                    d = d[first]
                    order = np.lexsort((names, d))[:k]
                    best[int(qid[at + i])] = (d[order], names[order])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(list(best), np.int64), [len(v[0]) for v in best.values()])), pa.array(np.concatenate([v[1] for v in best.values()])), pa.array(np.concatenate([v[0] for v in best.values()]))],
                names=["query", "entry", "d"],
            )

    return run
