"""Exact top-k search, its indexed variant, ranking helpers and fusion."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, text, vectors
from .packs import AGAIN, SLACK, TILE, nearest, places


def scored(rows: DataFrame, query: DataFrame, metric: str = "cosine", vector: str = "vector", name: str = "similarity") -> DataFrame:
    """rows with their similarity to a one-row query (q array<double>), which is broadcast."""
    return rows.crossJoin(F.broadcast(query)).withColumn(name, vectors.similarity(metric, F.col(vector), F.col("q"))).drop("q")


def recall(memories: DataFrame, query: DataFrame, k: int = 10, min_similarity: float = 0.05, types: list[str] | None = None, metric: str = "cosine") -> DataFrame:
    """The k best memories: similarity times max(1 - decay, 0.5), at least the minimum. The type filter reaches
    the scan; the plan ends in one TakeOrderedAndProject."""
    rows = memories.where(F.lower("memory_type").isin(*[t.lower() for t in types])) if types else memories
    rows = scored(rows, query, metric).withColumn("similarity", F.col("similarity") * F.greatest(1 - F.col("decay"), F.lit(0.5)))
    return rows.where(F.col("similarity") >= min_similarity).orderBy(F.desc("similarity"), "id").limit(k)


def search_chunks(chunks: DataFrame, files: DataFrame, query: DataFrame, k: int = 10, above: float = 0.25) -> DataFrame:
    """The k best chunks with their files; the boost by file type comes after the threshold. What is ranked needs no text: see with_content."""
    rows = scored(chunks, query).where(F.col("similarity") > above)
    joined = rows.join(files.select("path", "name", "ext"), rows.file_path == F.col("path")).drop("vector")
    return joined.withColumn("similarity", labels.type_boost(F.col("ext"), F.col("similarity"))).orderBy(F.desc("similarity"), "path", "chunk_index").limit(k)


def search_index(chunks: DataFrame, files: DataFrame, query: DataFrame, k: int = 10, least: float = 0.25, fetch: int = 3) -> DataFrame:
    """As search_chunks, as an index answers: of the `fetch` * k nearest chunks those with at least `least`, then the files and the boost."""
    rows = scored(chunks, query).drop("vector").orderBy(F.desc("similarity"), "file_path", "chunk_index").limit(k * fetch).where(F.col("similarity") >= least)
    joined = files.select("path", "name", "ext").join(F.broadcast(rows), rows.file_path == F.col("path"))  # rows are k * fetch
    return joined.withColumn("similarity", labels.type_boost(F.col("ext"), F.col("similarity"))).orderBy(F.desc("similarity"), "path", "chunk_index").limit(k)


def search_store(rows: DataFrame, files: DataFrame, query: DataFrame, k: int = 10, least: float = 0.25, fetch: int = 3, wide: int = 10) -> DataFrame:
    """As search_index over a store of all kinds of vectors (id, source, vector), where a chunk's id is `file::<path>::<number>`: of the `fetch` * k nearest of
    source file those with at least `least`. Where the store knows no source of files, of `wide` times as many nearest of all those whose id is a file's; other ids end there.
    Whether it knows one takes a job that ends at the first such row."""
    known = rows.where("source = 'file' and vector is not null")
    some = not known.select("id").isEmpty()
    near = scored(known if some else rows, query).drop("vector").orderBy(F.desc("similarity"), "id").limit(k * fetch * (1 if some else wide))
    name = F.regexp_extract("id", "(?s)^file::(.*)::([0-9]+)$", 1)
    number = F.regexp_extract("id", "(?s)^file::(.*)::([0-9]+)$", 2)
    near = near.where((F.col("similarity") >= least) & (number != "")).select(name.alias("path"), number.cast("bigint").alias("chunk_index"), "similarity")
    joined = files.select("path", "name", "ext").join(F.broadcast(near), "path")  # near has at most k * fetch * wide rows
    return joined.withColumn("similarity", labels.type_boost(F.col("ext"), F.col("similarity"))).orderBy(F.desc("similarity"), "path", "chunk_index").limit(k)


def sample(rows: DataFrame, n: int, key: str, seed: int = 3) -> DataFrame:
    """n rows by a hash of the seed and their key, ties by the key: the same ones whenever it is asked."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def with_content(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """A top-k of chunks with their texts."""
    texts = chunks.select("file_path", "chunk_index", "content")
    return texts.join(F.broadcast(hits), ["file_path", "chunk_index"])  # hits are k rows


def merge_by_file(hits: DataFrame) -> DataFrame:
    """One row for each file: its chunks in rank order, its best similarity and rank."""
    ranked = hits.withColumn("r", F.row_number().over(Window.orderBy(F.desc("similarity"), "path", "chunk_index")))  # hits are a top-k
    return ranked.groupBy("path", "name", "ext").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "content"))), lambda x: x["content"]), "\n\n").alias("content"), F.max("similarity").alias("similarity"), F.min("r").cast("bigint").alias("rank"))


#: Rows that pairs_above sends to blocks, each once to each; what would be more is packed, written and read (packs.nearest).
SENT = 1_000_000


def _kinds(y: np.ndarray) -> np.ndarray:
    """The number of each row's kind; rows that are equal are of one kind. Sums of the numbers' bits tell kinds apart; where two kinds have one sum, the rows themselves do."""
    bits = np.ascontiguousarray(y + 0.0).view(np.uint64)
    sums = np.zeros(len(bits), np.uint64)
    for c in range(bits.shape[1]):
        sums = (sums ^ bits[:, c]) * np.uint64(0x9E3779B97F4A7C15)
        sums ^= sums >> np.uint64(29)
    first, kind = np.unique(sums, return_index=True, return_inverse=True)[1:]
    kind = kind.ravel()
    if len(first) == len(bits):
        return kind
    more = np.flatnonzero(first[kind] != np.arange(len(bits)))
    if all((bits[p] == bits[first[kind[p]]]).all() for p in np.array_split(more, -(-len(more) // AGAIN))):
        return kind
    return np.unique(bits.view(np.dtype((np.void, bits.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()


def _copies(kind: np.ndarray, most: int) -> np.ndarray:
    """The places of the first `most` rows of each kind, in order."""
    order = np.argsort(kind, kind="stable")
    sorted_ = kind[order]
    nth = np.arange(len(kind)) - np.searchsorted(sorted_, sorted_)
    return np.sort(order[nth < most])


class _Best:
    """The k best rows of y so far for each row of x, a tile, above a similarity (times y's weight), of equal ones the first. `offer` takes a tile of products in single
    precision: what comes close to a row's k-th best is computed again in double precision, so equal rows are equally similar."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None, k: int, above: float, digits: int | None):
        self.x, self.y, self.weight, self.k, self.above, self.digits = x, y, weight, k, above, digits
        self.slack = SLACK * (1.0 if weight is None else max(1.0, float(np.abs(weight).max(initial=0))))
        self.least = np.full(len(x), above - self.slack, np.float32)
        self.row, self.col, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.fresh, self.waiting = True, 0

    def offer(self, near: np.ndarray, begin: int, across: bool) -> None:
        """near: this tile's rows, or its columns if `across`, with the rows of y from `begin`."""
        axis = 0 if across else 1
        if self.weight is not None:
            w = self.weight[begin : begin + near.shape[axis]].astype(np.float32)
            near = near * (w[:, None] if across else w)
        if self.fresh and near.shape[axis] > self.k:
            least = np.partition(near.T if across else near, -self.k, axis=1)[:, -self.k]
            self.least = np.maximum(self.least, least - np.float32(2 * self.slack))
        self.fresh = False
        flat = places(near >= (self.least if across else self.least[:, None]))
        for at in range(0, len(flat), AGAIN):
            r, c = np.divmod(flat[at : at + AGAIN], near.shape[1])
            r, c = (c, r + begin) if across else (r, c + begin)
            s = np.einsum("ij,ij->i", self.x[r], self.y[c])
            if self.weight is not None:
                s = s * self.weight[c]
            good = s > self.above
            self.new.append((r[good], c[good], s[good]))
            self.waiting += int(good.sum())
        if self.waiting > self.k * len(self.x):
            self.merge()

    def merge(self) -> None:
        if self.new:
            r, c, s = (np.concatenate(z) for z in zip((self.row, self.col, self.sim), *self.new, strict=True))
            order = np.lexsort((-(s if self.digits is None else np.round(s, self.digits)), r.astype(np.uint16)))  # stable: a row's pairs come by c
            r, c, s = r[order], c[order], s[order]
            nth = np.arange(len(r)) - np.searchsorted(r, np.arange(len(self.x)))[r]
            few = nth < self.k
            self.row, self.col, self.sim, nth = r[few], c[few], s[few], nth[few]
            full = nth == self.k - 1
            at = self.row[full]
            self.least[at] = np.maximum(self.least[at], (self.sim[full] - 2 * self.slack).astype(np.float32))
            self.new, self.waiting = [], 0


def _gathered(tops: list[_Best]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row of x, row of y, similarity of all tiles, by row, best first."""
    for t in tops:
        t.merge()
    if not tops:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate([t.row + n * TILE for n, t in enumerate(tops)]), np.concatenate([t.col for t in tops]), np.concatenate([t.sim for t in tops])


def _best(x: np.ndarray, y: np.ndarray | None, weights: tuple[np.ndarray | None, np.ndarray | None], k: int, above: float, digits: int | None, both: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, similarity) of the k best rows of y for each row of x, and, if `both`, the same the other way round; a tile's product serves both. Without y the
    rows of x are compared with each other."""
    tiles = lambda n: range(0, n, TILE)
    own = y is None
    y = x if own else y
    xs, ys = x.astype(np.float32), x.astype(np.float32) if own else y.astype(np.float32)
    of_x = [_Best(x[a : a + TILE], y, weights[1], k, above, digits) for a in tiles(len(x))]
    of_y = of_x if own else [_Best(y[b : b + TILE], x, weights[0], k, above, digits) for b in tiles(len(y))] if both else []
    for i, a in enumerate(tiles(len(x))):
        for j, b in enumerate(tiles(len(y))):
            if own and j < i:
                continue
            near = xs[a : a + TILE] @ ys[b : b + TILE].T
            of_x[i].offer(near, b, False)
            if (both or own) and not (own and i == j):
                of_y[j].offer(near, a, True)
    return [_gathered(of_x)] + ([_gathered(of_y)] if both and not own else [])


def _links(x: np.ndarray, own: np.ndarray, mass: np.ndarray, y: np.ndarray | None, others: np.ndarray, weight: np.ndarray, k: int, above: float, digits: int | None, both: bool) -> pa.Table:
    """src, dst, similarity: for each row of x the k best others, and, if `both`, for each row of y. Rows are sorted by id; of equal ones only k + 1 can be
    among the best, and what these find the rest finds too."""
    one = y is None
    kinds = [_kinds(np.column_stack([v, w])) for v, w in [(x, mass)] + ([] if one else [(y, weight)])]
    kept = [_copies(kind, k + 1) for kind in kinds]
    ids, masses = [own, own if one else others], [mass, mass if one else weight]
    less = [v if len(at) == len(v) else v[at] for v, at in zip([x] if one else [x, y], kept, strict=True)]
    plain = all((m == 1.0).all() for m in masses)
    w = (None, None) if plain else (masses[0][kept[0]], masses[1][kept[-1]])
    out = []
    for side, (row, col, sim) in enumerate(_best(less[0], None if one else less[1], w, k + 1, above, digits, both)):
        at, kind = kept[side], kinds[side]
        place = np.full(kind.max() + 1, len(at))
        np.minimum.at(place, kind[at], np.arange(len(at)))
        of = place[kind]
        first, count = np.searchsorted(row, np.arange(len(at))), np.bincount(row, minlength=len(at))
        n = count[of]
        src = np.repeat(np.arange(len(kind)), n)
        where = np.repeat(first[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        dst, sim = kept[-1 - side][col[where]], sim[where]
        apart = ids[side][src] != ids[1 - side][dst]
        src, dst, sim = src[apart], dst[apart], sim[apart]
        few = np.arange(len(src)) - np.searchsorted(src, src) < k
        out.append(pa.table({"src": pa.array(ids[side][src[few]], pa.string()), "dst": pa.array(ids[1 - side][dst[few]], pa.string()), "similarity": pa.array(sim[few], pa.float64())}))
    return pa.concat_tables(out)


def pairs_above(rows: DataFrame, k: int, above: float, key: str = "id", vector: str = "vector", block: int = 32768, only: DataFrame | None = None, weight: str | None = None, digits: int | None = None) -> DataFrame:
    """src, dst, similarity: for each row its k most similar other rows above a cosine similarity (times the weight of
    the other); with `digits`, similarities that agree in so many decimals count as equal. Exact: rows are dealt into blocks, each unordered pair of blocks is compared in Arrow,
    a tile of products at a time, each of which serves both sides, in a task of its own, and sends only the k best of each row; work grows with the square of the rows, memory with a block, and a row is sent once to each
    block. Where that would send more than SENT rows, they are packed and written, and tasks read them (`packs.nearest`), so disk grows with the rows. With `only` (a table of ids)
    neighbours are sought for these alone: work grows with their number times that of all rows. Beyond some million rows use neighbours.descent instead.
    Rows without an id or a vector, with a null or non-finite part, or of another length than most have no neighbours and are none."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    rows = rows.where(F.col(key).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    lengths = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").collect()  # one row for each length
    rows = rows.where(F.size(vector) == lengths[0].d) if len(lengths) > 1 else rows
    blocks = lambda count, least: max(1, -(-count // block), min(least, -(-count // 1024)))  # noqa: E731 - small tables still keep all cores busy
    n = blocks(lengths[0]["count"] if lengths else 0, 8)
    mass = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), mass.alias("w"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("b"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if only is None:
        if lengths and lengths[0]["count"] * n > SENT:
            return nearest(own, k, above, digits, None)
        met = own.withColumn("o", all_blocks).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") < F.col("o")).cast("int").alias("side"), "id", "v", "w")
    else:
        asked = own.join(only.select(F.col(only.columns[0]).alias("id")).distinct(), "id", "left_semi")
        some = asked.count()
        m = blocks(some, 4)
        if lengths and some * n + lengths[0]["count"] * m > SENT:
            return nearest(own, k, above, digits, only)
        asks = asked.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(m)).cast("int").alias("i"), all_blocks.alias("j"), F.lit(0).alias("side"), "id", "v", "w")
        met = asks.unionByName(own.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"), F.col("b").alias("j"), F.lit(1).alias("side"), "id", "v", "w"))

    asked_only = only is not None

    def best(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        apart = asked_only or group.column("i")[0] != group.column("j")[0]
        side, ids, w = np.asarray(group.column("side")), group.column("id").to_numpy(zero_copy_only=False), np.asarray(group.column("w"))
        x = np.asarray(group.column("v").combine_chunks().flatten()).reshape(len(ids), -1)
        del group
        x = x / np.maximum(np.linalg.norm(x, axis=1), vectors.TINY)[:, None]
        if not apart:
            return _links(x, ids, w, None, ids, w, k, above, digits, False)
        a, b = side == 0, side == 1
        if not (a.any() and b.any()):
            return pa.table({"src": pa.array([], pa.string()), "dst": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        y, x = x[b], x[a]
        return _links(x, ids[a], w[a], y, ids[b], w[b], k, above, digits, not asked_only)

    # Each pair of blocks has a partition of its own: by hashes several would share one, and the job would wait for it.
    here = F.col("i") * n - F.floor(F.col("i") * (F.col("i") - 1) / 2) + F.col("j") - F.col("i") if only is None else F.col("i") * n + F.col("j")
    dealt = met.withColumn("g", here.cast("int")).repartitionById(n * (n + 1) // 2 if only is None else n * m, "g")
    found = dealt.groupBy("g").applyInArrow(best, "src string, dst string, similarity double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity") if digits is None else F.desc(F.round("similarity", digits)), "dst"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


class InvertedFileIndex:
    """An index of cells around k-means centres; a search probes the nearest cells and ranks exactly there.
    With a folder (one that all executors share) rows are written there by cell, so a probe reads its cells only; without, every search assigns them again.
    Deleted ids are tombstones until they exceed a fifth, when the index is rebuilt without them."""

    def __init__(self, rows: DataFrame, cells: int = 16, key: str = "id", vector: str = "vector", seed: int = 7, folder: str | None = None):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.cells, self.seed, self.folder = cells, seed, folder
        ready = rows.select(F.col(key).alias("id"), vectors.normalize(F.col(vector).cast("array<double>")).alias("vector")).withColumn("features", array_to_vector("vector"))
        self.model = KMeans(k=cells, seed=seed, maxIter=12).fit(ready)
        self.rows = self.model.transform(ready).select("id", "vector", F.col("prediction").alias("cell"))
        if folder:
            path = f"{folder}/cells-{uuid.uuid4().hex}"
            self.rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(path)
            self.rows = rows.sparkSession.read.schema(self.rows.schema).parquet(path)
        self.stale: DataFrame | None = None

    def delete(self, ids: DataFrame) -> InvertedFileIndex:
        self.stale = ids if self.stale is None else self.stale.unionByName(ids).distinct()
        if self.stale.count() > 0.2 * self.rows.count():
            return InvertedFileIndex(self.rows.join(self.stale, "id", "left_anti"), self.cells, seed=self.seed, folder=self.folder)
        return self

    def search(self, query: list[float], k: int, probes: int = 4) -> DataFrame:
        centres = np.array(self.model.clusterCenters())
        nearest = np.argsort(((centres - np.asarray(query) / max(np.linalg.norm(query), vectors.TINY)) ** 2).sum(1))[:probes]
        rows = self.rows.where(F.col("cell").isin([int(c) for c in nearest]))
        if self.stale is not None:
            rows = rows.join(self.stale, "id", "left_anti")
        q = F.array(*[F.lit(float(x)) for x in query])
        return rows.withColumn("similarity", vectors.cosine(F.col("vector"), q)).orderBy(F.desc("similarity"), "id").limit(k).select("id", "similarity")


def hopfield(patterns: DataFrame, query: DataFrame, k: int = 5, beta: float = 8.0) -> DataFrame:
    """Associative retrieval: the k most similar patterns and their softmax weights at inverse temperature beta."""
    top = scored(patterns, query).orderBy(F.desc("similarity"), "id").limit(k)
    return top.withColumn("weight", F.exp(beta * F.col("similarity")) / F.sum(F.exp(beta * F.col("similarity"))).over(Window.partitionBy())).select("id", "similarity", "weight")


def rerank_features(hits: DataFrame, as_of_ms: int, wanted_type: str) -> DataFrame:
    return hits.withColumns({"f_access": F.log1p("access_count") / 10, "f_recency": F.exp((F.col("timestamp") - F.lit(as_of_ms)) / 86_400_000), "f_type": F.when(F.lower("memory_type") == wanted_type.lower(), 1.0).otherwise(0.0), "f_index": F.col("similarity")})


def blend(index_score: Column, other: Column, weight: float = 0.7) -> Column:
    return weight * index_score + (1 - weight) * other


def attention_rerank(hits: DataFrame, edges: DataFrame, nodes: DataFrame, query: DataFrame, heads: int = 4) -> DataFrame:
    """Blend of the index score and the cosine of a neighbour-aware vector: in each head, a slice of the vector, the
    neighbours' mean by softmax attention is added to a candidate's own. Without neighbours it is the plain cosine."""
    near = hits.select(F.col("id").alias("src"), F.col("vector").alias("own")).join(edges.select("src", "dst"), "src").join(nodes.select(F.col("id").alias("dst"), F.col("vector").alias("other")), "dst")
    dim = F.size("own")
    part = lambda v, h: F.slice(v, (F.floor(dim * h / heads) + 1).cast("int"), (F.floor(dim * (h + 1) / heads) - F.floor(dim * h / heads)).cast("int"))
    parts = None
    for h in range(heads):
        one = near.select("src", F.lit(h).alias("h"), part(F.col("own"), h).alias("a"), part(F.col("other"), h).alias("b"))
        parts = one if parts is None else parts.unionByName(one)
    weight = F.exp(vectors.dot(F.col("a"), F.col("b")) / F.sqrt(F.size("a")))
    spread = parts.withColumn("w", weight).select("src", "h", "w", F.posexplode(F.arrays_zip("a", "b")).alias("i", "x"))
    mixed = spread.groupBy("src", "h", "i").agg((F.first("x.a") + F.sum(F.col("w") * F.col("x.b")) / F.sum("w")).alias("y"))
    aware = mixed.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "i", "y"))), lambda s: s["y"]).alias("aware"))
    out = hits.join(aware, hits.id == aware.src, "left").crossJoin(F.broadcast(query))
    other = vectors.cosine(F.coalesce("aware", "vector"), F.col("q"))
    return out.withColumn("score", blend(F.col("similarity"), other)).select("id", "similarity", "score").orderBy(F.desc("score"), "id")


def pattern_boost(patterns: DataFrame, query: DataFrame, k: int = 5) -> DataFrame:
    """The quality that similar patterns had: a similarity-weighted mean over the k nearest, 0.5 without any."""
    near = scored(patterns, query).orderBy(F.desc("similarity"), "id").limit(k).withColumn("w", F.greatest("similarity", F.lit(0.0)))
    return near.agg(F.coalesce(F.sum(F.col("w") * F.col("quality")) / F.nullif(F.sum("w"), F.lit(0.0)), F.lit(0.5)).alias("boost"))


def budget(hits: DataFrame, limit: int = 20_000) -> DataFrame:
    """Fused hits (source email, file or system; rank; similarity; content) with their part of a context budget: mail
    shares 40 % equally, files half by similarity with at least 200, system results a tenth equally."""
    own = Window.partitionBy("source")
    whole, count = F.sum("similarity").over(own), F.count("*").over(own)
    weight = F.when(whole > 0, F.col("similarity") / whole).otherwise(1 / count)
    chars = (
        F.when(F.col("source") == "email", F.floor(limit * 40 // 100 / count)).when(F.col("source") == "file", F.floor(F.greatest(limit * 50 // 100 * weight, F.lit(200.0)))).otherwise(F.floor(limit * 10 // 100 / count))
    )
    return hits.withColumn("chars", chars.cast("int")).withColumn("content", text.truncate_words(F.col("content"), F.col("chars"))).withColumn("chars", F.col("chars").cast("bigint"))


def context_text(hits: DataFrame) -> DataFrame:
    """Memories as numbered lines of one text."""
    line = F.format_string("%d. [%s] (similarity: %.2f): %s", F.col("r"), F.lower("memory_type"), F.col("similarity"), F.col("content"))
    ranked = hits.withColumn("r", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))  # hits are a top-k
    return ranked.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def fan_out(sources: dict[str, tuple[Callable[[], DataFrame], list[str], str]], needle: str, each: int) -> DataFrame:
    """source, id: the first rows by key of each source (how to get it, its key, the text searched) that hold a text, whatever its
    case. A source that can't be opened gives no rows and doesn't stop the others; without any there is an empty table."""
    from pyspark.sql import SparkSession

    out = None
    for name, (open_, key, column) in sources.items():
        try:
            hit = open_().where(F.contains(F.lower(column), F.lit(needle.lower()))).orderBy(*key).limit(each).select(F.lit(name).alias("source"), F.concat_ws("/", *key).alias("id"))
        except PySparkException:
            continue
        out = hit if out is None else out.unionByName(hit)
    return SparkSession.active().createDataFrame([], "source string, id string") if out is None else out
