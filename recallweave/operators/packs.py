"""All pairs of a large table without a shuffle of its rows for each block: rows are packed, thousands of vectors to a row, and written once; tasks read them from there.

Copies are found first: of rows with one vector and weight one is compared, and what it finds all of them find. A task holds some packs of the asked rows and their best
so far, and the packs of all rows pass by (a cross join of written packs, which moves nothing else), so disk grows with the rows, memory with a pack and work with the square of the distinct vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.scratch import forget, written

#: Rows and columns of the products that are compared at a time, pairs that are computed again at a time; more than the error of a product in single precision.
TILE, AGAIN, SLACK = 1024, 1 << 14, 1e-5
#: Rows of a pack, tasks that compare packs where there are enough, packs that a batch brings to a task.
PACK, TASKS, AT_ONCE = 16384, 96, 2

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero; eight at a time, since few are set."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    eight = np.flatnonzero(flat.view(np.uint64))
    if len(eight) * 16 > flat.size // 8:
        return np.flatnonzero(flat)
    at = (eight[:, None] * 8 + np.arange(8)).ravel()
    return at[flat[at]]


class _Nearest:
    """The k best rows so far for each row of x, a tile, above a similarity; of equal ones those of lower number. What comes close to a row's k-th best by a product in
    single precision is computed again in double precision."""

    def __init__(self, x: np.ndarray, k: int, above: float, digits: int | None):
        self.x, self.x32, self.k, self.above, self.digits = x, x.astype(np.float32), k, above, digits
        self.kth = np.full(len(x), -np.inf)
        self.row, self.no, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.fresh, self.waiting = True, 0

    def offer(self, y: np.ndarray, y32: np.ndarray, w: np.ndarray | None, no: np.ndarray, slack: float) -> None:
        near = self.x32 @ y32.T
        if w is not None:
            near *= w.astype(np.float32)
        if self.fresh and near.shape[1] >= self.k:
            self.kth = np.partition(near, -self.k, axis=1)[:, -self.k].astype(np.float64)
            self.kth[np.isnan(self.kth)] = -np.inf
            self.fresh = False
        least = np.maximum(self.kth - 2 * slack, self.above - slack).astype(np.float32)
        flat = places(near >= least[:, None])
        for at in range(0, len(flat), AGAIN):
            r, c = np.divmod(flat[at : at + AGAIN], near.shape[1])
            s = np.einsum("ij,ij->i", self.x[r], y[c])
            s = s if w is None else s * w[c]
            good = s > self.above
            self.new.append((r[good], no[c[good]], s[good]))
            self.waiting += int(good.sum())
        if self.waiting > self.k * len(self.x):
            self.merge()

    def merge(self) -> None:
        if self.new:
            r, no, s = (np.concatenate(z) for z in zip((self.row, self.no, self.sim), *self.new, strict=True))
            order = np.lexsort((no, -(s if self.digits is None else np.round(s, self.digits)), r))
            r, no, s = r[order], no[order], s[order]
            nth = np.arange(len(r)) - np.searchsorted(r, np.arange(len(self.x)))[r]
            few = nth < self.k
            self.row, self.no, self.sim, nth = r[few], no[few], s[few], nth[few]
            full = nth == self.k - 1
            at = self.row[full]
            self.kth[at] = np.maximum(self.kth[at], self.sim[full])
            self.new, self.waiting = [], 0


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, x (the bytes of a row's numbers and its weight), h (a hash of these), asked."""
    for batch in batches:
        if batch.num_rows:
            v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            x = [r.tobytes() for r in np.column_stack([v, np.asarray(batch.column(2).fill_null(np.nan))]) + 0.0]
            h = [hashlib.blake2b(b, digest_size=24).digest() for b in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), pa.array(h, pa.binary()), batch.column(3)], names=["id", "x", "h", "asked"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with numbers in their order; partitions are ranges."""
    at = TaskContext.get().partitionId() << 33
    for batch in batches:
        no = pa.array(np.arange(at, at + batch.num_rows))
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, no], names=[*batch.schema.names, "no"])


def _packed(size: int):
    """p (a number of the pack), no (its rows' numbers) and x (their bytes) of up to `size` rows each."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        no, x = np.concatenate([np.asarray(h.column(0)) for h in held]), b"".join(b for h in held for b in h.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([pa.array([int(no[0])]), pa.array([no.tobytes()], pa.binary()), pa.array([x], pa.binary())], names=["p", "no", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(size - n, batch.num_rows - at)
                held.append(batch.slice(at, take))
                n, at = n + take, at + take
                if n == size:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    return run


def _unpacked(no: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Numbers, unit vectors, and weights where they aren't 1."""
    number = np.frombuffer(no, np.int64)
    both = np.frombuffer(x, np.float64).reshape(len(number), -1)
    v, w = both[:, :-1], both[:, -1]
    return number, v / np.maximum(np.linalg.norm(v, axis=1), vectors.TINY)[:, None], None if (w == 1.0).all() else w


def _compared(k: int, above: float, digits: int | None):
    """src, dst, similarity by numbers: the k best of the packs (no, x) that pass for each row of the packs (p, ano, ax) that are asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple[np.ndarray, list[_Nearest]]] = {}
        last, other = None, None
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                p, q = at["p"][i].as_py(), at["q"][i].as_py()
                if p not in asked:
                    number, x, _ = _unpacked(at["ano"][i].as_buffer(), at["ax"][i].as_buffer())
                    asked[p] = number, [_Nearest(x[a : a + TILE], k, above, digits) for a in range(0, len(x), TILE)]
                if q != last:
                    number, y, w = _unpacked(at["no"][i].as_buffer(), at["x"][i].as_buffer())
                    last, other = q, (number, y, y.astype(np.float32), w, SLACK * (1.0 if w is None else max(1.0, float(np.abs(w).max()))))
                number, y, y32, w, slack = other
                for b in range(0, len(y), TILE):
                    part = slice(b, b + TILE)
                    for tile in asked[p][1]:
                        tile.offer(y[part], y32[part], None if w is None else w[part], number[part], slack)
        for number, tiles in asked.values():
            for n, tile in enumerate(tiles):
                tile.merge()
                yield pa.RecordBatch.from_arrays([pa.array(number[tile.row + n * TILE]), pa.array(tile.no), pa.array(tile.sim)], names=["src", "dst", "similarity"])

    return run


def _first(rows: DataFrame, k: int, by: str, *order: Column) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("r") <= k).drop("r")


def nearest(rows: DataFrame, k: int, above: float, digits: int | None, only: DataFrame | None, size: int = PACK) -> DataFrame:
    """src, dst, similarity as search.pairs_above gives them, for rows (id, v, w) that can be compared. What tasks share is written; packs go when they have been read."""
    spark = rows.sparkSession
    asks = rows.withColumn("asked", F.lit(True)) if only is None else rows.join(only.select(F.col(only.columns[0]).alias("id")).distinct().withColumn("asked", F.lit(True)), "id", "left")
    own = written(asks.select("id", "v", F.col("w").cast("double").alias("w"), F.coalesce("asked", F.lit(False)).alias("asked")).mapInArrow(_hashed, "id string, x binary, h binary, asked boolean"), "own")
    kinds = own.groupBy("h").agg(F.min("id").alias("id"), F.any_value("x").alias("x"), F.bool_or("asked").alias("asked"))
    parts = max(1, -(-own.count() // (4 * size)))
    kinds = written(kinds.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(_numbered, "h binary, id string, x binary, asked boolean, no long"), "kinds")
    members = written(own.select("h", "id", "asked").join(kinds.select("h", "no"), "h").select("no", "id", "asked"), "members")
    forget(own)
    pack = lambda part: written(part.select("no", "x").mapInArrow(_packed(size), "p long, no binary, x binary"), "packs")
    all_packs = pack(kinds)
    some_packs = all_packs if only is None else pack(kinds.where("asked"))
    forget(kinds)
    tasks = max(1, some_packs.count())
    # The asked packs are dealt one to a task; the others are read by so many more tasks as keep all busy.
    dealt = some_packs.select("p", (F.row_number().over(Window.orderBy("p")) - 1).alias("g"))  # a number for each pack
    asked = some_packs.join(F.broadcast(dealt), "p").repartitionById(tasks, "g").select("p", F.col("no").alias("ano"), F.col("x").alias("ax"))
    passing = all_packs.select(F.col("p").alias("q"), "no", "x").coalesce(max(1, -(-TASKS // tasks)))
    before = spark.conf.get(BATCH_ROWS, None)
    spark.conf.set(BATCH_ROWS, str(AT_ONCE))  # a pack is one row
    try:
        near = written(passing.crossJoin(asked).mapInArrow(_compared(k + 1, above, digits), "src long, dst long, similarity double"), "near")
    finally:
        spark.conf.unset(BATCH_ROWS) if before is None else spark.conf.set(BATCH_ROWS, before)
    for packs in {id(p): p for p in (all_packs, some_packs)}.values():
        forget(packs)
    value = F.desc("similarity") if digits is None else F.desc(F.round("similarity", digits))
    kept = _first(near, k + 1, "src", value, F.col("dst"))
    copies = _first(members.select(F.col("no").alias("dst"), "id"), k + 1, "dst", F.col("id"))
    found = _first(kept.join(copies, "dst").select("src", F.col("id").alias("dst"), "similarity"), k + 1, "src", value, F.col("dst"))
    pairs = members.where("asked").select(F.col("no").alias("src"), "id").join(found, "src").where(F.col("id") != F.col("dst"))
    return _first(pairs.select(F.col("id").alias("src"), "dst", "similarity"), k, "src", value, F.col("dst"))
