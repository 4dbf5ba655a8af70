"""A vector index of cells with product-quantised residuals that takes inserts, re-inserts and deletes.

Below its folder: `model` (cell centres and codebooks, one row each), `rows/version=N/cell=C` (id, code, unit vector) and
`stale/version=N` (ids whose rows of earlier versions no longer count). Each insert or delete is one version, written aside and renamed into place, so
readers see whole versions. A search probes the cells nearest to each query, ranks there by codes alone (the distance of a
query's residual to the coded one, by table look-up), fetches more than is asked by the share of stale rows, drops stale ones, and ranks the short list by exact
cosine. Past a fifth of stale rows `rebuilt` writes a new index of what is live.

Centres and codebooks are learned from a bounded sample; all rows are indexed. Queries are broadcast in blocks of QUERIES.
Rows that can't be compared (null or non-finite parts, zero, odd length, no id) are not indexed; of new rows that share an id one counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import rename_new
from .neighbours import matrix, usable

SAMPLE, QUERIES = 20_000, 1024
#: Distances that a task holds at a time, whatever the batch.
HELD = 1 << 20
ROWS = "id string, code binary, v array<double>, version int, cell int"


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """At most k centres of a sample."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


class Model:
    """Centres (cells x d) and, for each of the parts of a vector, codewords of residuals."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        self.edges = np.cumsum([0, *[b.shape[1] for b in books]])

    @classmethod
    def learn(cls, x: np.ndarray, cells: int, parts: int, words: int, seed: int) -> Model:
        centres = lloyd(x, cells, seed)
        rest = x - centres[nearest(x, centres)]
        return cls(centres, [lloyd(p, words, seed + 1 + i) for i, p in enumerate(np.array_split(rest, min(parts, x.shape[1]), axis=1))])

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[..., a:b] for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, a byte for each part)."""
        cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        return cell, np.stack([nearest(p, b) for p, b in zip(self.parts(rest), self.books, strict=True)], axis=1).astype(np.uint8)

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded rows of a cell."""
        out = np.zeros((len(queries), len(codes)))
        for j, (p, b) in enumerate(zip(self.parts(queries - self.centres[cell]), self.books, strict=True)):
            table = (p**2).sum(1)[:, None] + (b**2).sum(1) - 2 * p @ b.T
            out += table[:, codes[:, j]]
        return out

    def nearest_coded(self, queries: np.ndarray, cell: int, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of codes, squared distance) of the k nearest coded rows for each query, of equally near ones the first. Rows come a slice at a time, so that no more than HELD distances, and
        those kept, are in memory."""
        k, width = min(k, len(codes)), max(1, HELD // max(1, len(queries)))
        at, far = np.zeros((len(queries), 0), np.int32), np.zeros((len(queries), 0))
        for begin in range(0, len(codes), width):
            d = np.concatenate([far, self.distances(queries, cell, codes[begin : begin + width])], axis=1)
            own = np.arange(begin, min(begin + width, len(codes)), dtype=np.int32)
            rows = np.concatenate([at, np.broadcast_to(own, (len(queries), len(own)))], axis=1)
            if d.shape[1] > k:
                last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                nearer, equal = d < last, d == last
                kept = nearer | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - nearer.sum(axis=1, keepdims=True)))
                d, rows = d[kept].reshape(-1, k), rows[kept].reshape(-1, k)
            at, far = rows, d
        return at, far


class ResidualIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        stored = spark.read.schema("kind int, at int, v array<double>").parquet(f"{self.folder}/model").orderBy("kind", "at").collect()  # bounded by cells, parts and words
        books: dict[int, list] = {}
        for r in stored:
            books.setdefault(r.kind, []).append(r.v)
        self.model = Model(np.array(books.pop(-1)), [np.array(books[j]) for j in sorted(books)])

    @classmethod
    def build(cls, rows: DataFrame, folder: str, cells: int = 16, parts: int = 16, words: int = 64, sample: int = SAMPLE, key: str = "id", vector: str = "vector", seed: int = 7) -> ResidualIndex:
        spark = rows.sparkSession
        own = usable(rows, key, vector)
        n = own.count()
        if not n:
            raise ValueError("an index needs a row to learn from")
        some = own.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, -(-n // sample)))) == 0).select("v").toArrow()
        some = some if len(some) else own.select("v").limit(1).toArrow()
        model = Model.learn(matrix(some.column(0)), cells, parts, words, seed)
        stored = [(-1, i, c.tolist()) for i, c in enumerate(model.centres)] + [(j, i, w.tolist()) for j, b in enumerate(model.books) for i, w in enumerate(b)]
        spark.createDataFrame(stored, "kind int, at int, v array<double>").coalesce(1).write.parquet(f"{folder.rstrip('/')}/model")
        index = cls(spark, folder)
        index.insert(rows, key, vector)
        return index

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _last(self) -> int:
        found = [0]
        for name in ("rows", "stale"):
            fs, path = self._path(name)
            found += [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path)] if fs.exists(path) else []
        return max(found)

    def _place(self, df: DataFrame, name: str, version: int, by: list[str]) -> None:
        aside = f"{self.folder}/aside-{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(aside)
        if not rename_new(self.spark, aside, f"{self.folder}/{name}/version={version}"):
            raise RuntimeError(f"another writer has placed version {version}; try again")

    def insert(self, rows: DataFrame, key: str = "id", vector: str = "vector") -> int:
        """Add rows; earlier rows of their ids become stale. Gives the version, which is seen once it is whole."""
        model, version = self.model, self._last() + 1

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, code = model.encode(matrix(batch.column(1)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), batch.column(1), pa.array(cell.astype(np.int32))], names=["id", "code", "v", "cell"])

        width = self.model.centres.shape[1]
        ready = usable(rows, key, vector).where(F.size("v") == width).mapInArrow(coded, "id string, code binary, v array<double>, cell int")
        ids = rows.select(F.col(key).cast("string").alias("id")).where("id is not null").distinct()
        if version > 1:  # first, so that no reader meets two live rows of one id
            self._place(ids, "stale", version, [])
        # Cells can be hot: each is dealt to several tasks.
        self._place(ready.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))), "rows", version, ["cell"])
        return version

    def delete(self, ids: DataFrame) -> int:
        version = self._last() + 1
        self._place(ids.select(F.col(ids.columns[0]).cast("string").alias("id")).where("id is not null").distinct(), "stale", version, [])
        return version

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.folder}/rows")

    def _without_stale(self, rows: DataFrame) -> DataFrame:
        fs, path = self._path("stale")
        if not fs.exists(path):
            return rows
        stale = self.spark.read.schema("id string, version int").parquet(f"{self.folder}/stale").groupBy("id").agg(F.max("version").alias("upto"))
        return rows.join(stale, "id", "left").where(F.col("upto").isNull() | (F.col("version") >= F.col("upto"))).drop("upto")

    def live(self) -> DataFrame:
        """id, v, version, cell of the rows that count."""
        return self._without_stale(self.rows().select("id", "v", "version", "cell"))

    def stale_share(self) -> float:
        rows = self.rows().select("id", "version")
        return 1 - self._without_stale(rows).count() / max(1, rows.count())

    def rebuilt(self, folder: str, past: float = 0.2, **how) -> ResidualIndex:
        """This index, or a new one in `folder` of its live rows if more than `past` of them are stale."""
        return self if self.stale_share() <= past else ResidualIndex.build(self.live(), folder, vector="v", **how)

    def search(self, queries: DataFrame, k: int, probes: int = 4, refine: int = 8, key: str = "id", vector: str = "vector") -> DataFrame:
        """query, rank, id, similarity: for each query vector its k most similar live rows among those that the codes name, ties to the smaller id."""
        asked = usable(queries, key, vector).where(F.size("v") == self.model.centres.shape[1])
        n, share = asked.count(), self.stale_share()
        fetch = int(np.ceil(k * refine / max(0.05, 1 - share)))
        out = self.spark.createDataFrame([], "query string, rank int, id string, similarity double")
        blocks = -(-n // QUERIES)
        for i in range(blocks):
            own = asked.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)) == i)
            out = out.unionByName(self._block(own, k, probes, fetch))
        return out

    def _block(self, asked: DataFrame, k: int, probes: int, fetch: int) -> DataFrame:
        got = asked.orderBy("id").toArrow()  # about QUERIES vectors
        if not len(got):
            return self.spark.createDataFrame([], "query string, rank int, id string, similarity double")
        names, q, model = got.column("id").to_pylist(), matrix(got.column("v")), self.model
        far = (model.centres**2).sum(1) - 2 * q @ model.centres.T
        probed = np.argsort(far, axis=1, kind="stable")[:, :probes]
        by_cell = {int(c): np.flatnonzero((probed == c).any(axis=1)) for c in np.unique(probed)}
        sent = self.spark.sparkContext.broadcast((model, q, by_cell))

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, q, by_cell = sent.value
            for batch in batches:
                batch = batch.sort_by([("id", "ascending"), ("version", "ascending")])  # so ties are cut as they are below
                ids, cell, version = batch.column("id"), batch.column("cell").to_numpy(), batch.column("version").to_numpy()
                for c in np.unique(cell):
                    at, asks = np.flatnonzero(cell == c), by_cell[int(c)]
                    codes = np.frombuffer(b"".join(batch.column("code").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                    best, d = model.nearest_coded(q[asks], int(c), codes, fetch)
                    rows = at[best.ravel()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(asks, best.shape[1]).astype(np.int32)), ids.take(pa.array(rows)), pa.array(cell[rows]), pa.array(version[rows]), pa.array(d.ravel())],
                        names=["asker", "id", "cell", "version", "far"],
                    )

        cells = F.col("cell").isin(*by_cell)
        found = self.rows().where(cells).select("id", "code", "cell", "version").mapInArrow(rank, "asker int, id string, cell int, version int, far double")
        short = found.withColumn("r", F.row_number().over(Window.partitionBy("asker").orderBy("far", "id", "version"))).where(F.col("r") <= fetch)
        short = self._without_stale(short.select("asker", "id", "cell", "version"))
        with_vectors = self.rows().where(cells).select("id", "cell", "version", "v").join(F.broadcast(short), ["id", "cell", "version"])  # QUERIES times fetch narrow rows
        query = self.spark.createDataFrame([(i, name, v.tolist()) for i, (name, v) in enumerate(zip(names, q, strict=True))], "asker int, query string, q array<double>")
        dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        exact = with_vectors.join(F.broadcast(query), "asker").select("query", "id", dot.alias("similarity"))
        order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
        return exact.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query", "rank", "id", "similarity")
