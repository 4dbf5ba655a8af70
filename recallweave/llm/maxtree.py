"""Ranked lexical search by branch and bound in max trees.

Documents stand in shards of SHARD; inside one, ranges of LEAF documents are the leaves of a tree with FAN children a node. Each
term has, for every node that holds it, the largest share it adds to a score there. The bound of a node for an item is the weighted sum of its
terms' maxima: no document below scores more. An item's search opens nodes by falling bound, scores the documents of the
leaves it reaches in whole numbers, and ends when the best bound left is under its k-th score. Nodes whose bound
equals that score are opened too, since a tie may go to a smaller id.

The index is built from one written table (id, length, codes and counts of the items' terms) by the task that searches it: shards are
runs of its rows, so postings are never shuffled. A task keeps the best of its shards and goes on with their k-th scores. Before
all shards, a sample is searched; the k-th score of an item there is a lower bound of its true one, so it prunes and drops nothing.

A score sums w * ((10**9 * tf) div (1000 * tf + 8 * m)) over an item's terms, once each, with w = floor(1000 ln((2N + 2) / (2 df + 1)))
and m = 100 - b + ((b * n * N) div L).

Items are taken in blocks of about TERMS distinct terms, which is what is broadcast; each block reads the documents once.

Edge cases: null and empty texts have no terms: such documents are not counted, such items have no result; rows of one item id are one item
(all their terms, once each); rows of one document id are documents of their own; a null id goes before others among ties.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .terms import coded_counts, lists, term_list
from .textkit import string_buffers

LEAF, FAN, SHARD = 16, 8, 8192
#: Postings after which a shard ends even if it has fewer documents, distinct terms of a block of items, and documents of the sample.
POSTINGS, TERMS, SAMPLE = 2_000_000, 200_000, 20_000
NULL_ID = -(1 << 63)
INDEXED = "id long, n long, term array<int>, tf array<long>"
FOUND = "item int, id long, score long"


class Shard:
    """Postings of some documents and the max tree of every term over them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, term: np.ndarray, share: np.ndarray):
        self.ids, self.term, self.share = ids, term, share
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        node = np.repeat(np.arange(len(ids)) // LEAF, lengths)
        width = max(1, -(-len(ids) // LEAF))
        key = term.astype(np.int64) * width + node
        order = np.argsort(key, kind="stable")
        self.levels = [self._maxima(key[order], share[order], width)]
        while width > 1:
            keys, most, _ = self.levels[-1]
            up = max(1, -(-width // FAN))
            self.levels.append(self._maxima(keys // width * up + keys % width // FAN, most, up))
            width = up

    @staticmethod
    def _maxima(key: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(keys once, their largest values, nodes of the level); key = term * width + node, ascending."""
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return key[first], np.maximum.reduceat(value, first) if len(first) else value[:0], width

    def bounds(self, level: int, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        keys, most, width = self.levels[level]
        if not len(keys):
            return np.zeros(len(nodes), np.int64)
        asked = terms[:, None] * width + nodes[None, :]
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return (np.where(keys[at] == asked, most[at], 0) * weights[:, None]).sum(axis=0)

    def search(self, terms: np.ndarray, weights: np.ndarray, by_term: np.ndarray, best: list[tuple[int, int]], k: int, floor: int) -> int:
        """Put the k best (score, -id) into the heap `best`, none below `floor` or 1; by_term holds the weights at their terms.
        Returns how many leaves were opened."""
        top, opened = len(self.levels) - 1, 0
        nodes = np.arange(self.levels[top][2])
        queue = [(-b, top, i) for i, b in zip(nodes.tolist(), self.bounds(top, nodes, terms, weights).tolist(), strict=True)]
        heapq.heapify(queue)
        while queue:
            least = max(floor, 1, best[0][0] if len(best) == k else 0)
            bound, level, i = heapq.heappop(queue)
            if -bound < least:
                break
            if level:
                nodes = np.arange(i * FAN, min((i + 1) * FAN, self.levels[level - 1][2]))
                for j, b in zip(nodes.tolist(), self.bounds(level - 1, nodes, terms, weights).tolist(), strict=True):
                    if b >= least:
                        heapq.heappush(queue, (-b, level - 1, j))
                continue
            opened += 1
            lo, hi = i * LEAF, min((i + 1) * LEAF, len(self.ids))
            a, b = self.at[lo], self.at[hi]
            run = np.concatenate([[0], np.cumsum(by_term[self.term[a:b]] * self.share[a:b])])
            scores = run[self.at[lo + 1 : hi + 1] - a] - run[self.at[lo:hi] - a]
            for d in np.flatnonzero(scores >= least).tolist():
                entry = (int(scores[d]), -int(self.ids[lo + d]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return opened


def _index(known):
    """id, n, and the codes and counts of the known terms, of each text that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = known.value
        get, missing = code.get, -1

        def codes(words: list[bytes]) -> np.ndarray:
            return np.fromiter((get(w, missing) for w in words), np.int64, len(words))

        for batch in batches:
            n, row, term, tf = coded_counts(batch.column(1), codes, max(1, len(code)))
            some = np.flatnonzero(n)
            terms, counts = lists(np.searchsorted(some, row), len(some), term.astype(np.int32), tf)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(n[some]), terms, counts], names=["id", "n", "term", "tf"])

    return run


def _search(asked, docs: int, terms: int, b: int, k: int):
    """The best of a task's documents for every item. asked: ([(terms, weights, floor)], number of terms)."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        held: list[pa.RecordBatch] = []
        rows = postings = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                rows, postings = rows + part.num_rows, postings + len(part.column(2).flatten())
                if rows >= SHARD or postings >= POSTINGS:
                    yield shard(held)
                    held, rows, postings = [], 0, 0
        if held:
            yield shard(held)

    def shard(held: list[pa.RecordBatch]) -> Shard:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, n = np.asarray(t["id"].fill_null(NULL_ID)), np.asarray(t["n"])
        each = np.asarray(t["term"].combine_chunks().value_lengths()).astype(np.int64)
        term, tf = (np.asarray(t[c].combine_chunks().flatten()) for c in ("term", "tf"))
        m = np.array([100 - b + b * x * docs // terms for x in n.tolist()], np.int64)
        share = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, each))
        return Shard(ids, each, term, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, width = asked.value
        by_term = np.zeros(max(1, width), np.int64)
        best: dict[int, list[tuple[int, int]]] = {}
        for s in shards(batches):
            for i, (term, weight, floor) in enumerate(items):
                if len(term):
                    by_term[term] = weight
                    s.search(term, weight, by_term, best.setdefault(i, []), k, floor)
                    by_term[term] = 0
        for i, heap in best.items():
            ids = pa.array([None if -d == NULL_ID else -d for _, d in heap], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(heap), pa.int32()), ids, pa.array([s for s, _ in heap], pa.int64())], names=["item", "id", "score"])

    return run


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = string_buffers(batch.column(1))
        found = [list(dict.fromkeys(term_list(raw[a:b].tobytes()))) for a, b in zip(at[:-1], at[1:], strict=True)]
        owner = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array([w for f in found for w in f], pa.binary())], names=["item_id", "term"])


def _within(found: DataFrame, k: int) -> DataFrame:
    """rank of the k best of each item; Spark limits each task's rows before they meet."""
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _block(docs: DataFrame, rows: list, key: str, text: str, k: int, b: int) -> DataFrame:
    """item_id, rank, id, score for items given as their (item_id, term) rows."""
    spark = docs.sparkSession
    code: dict[bytes, int] = {}
    by_item: dict = {}
    for r in rows:
        by_item.setdefault(r.item_id, []).append(code.setdefault(bytes(r.term), len(code)))
    known = spark.sparkContext.broadcast(code)
    index = settle(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_index(known), INDEXED), "term-index")
    n, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(index.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*")).collect())
    counts = spark.createDataFrame([(t, df.get(t, 0)) for t in range(len(code))], "term int, df long")
    weight = np.zeros(len(code), np.int64)
    for r in counts.select("term", F.floor(1000 * F.ln(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).alias("w")).collect():
        weight[r.term] = r.w
    ids = list(by_item)
    terms = [np.array(sorted(by_item[i]), np.int64) for i in ids]

    def search(some: DataFrame, floors: dict[int, int]) -> DataFrame:
        asked = spark.sparkContext.broadcast(([(t[weight[t] > 0], weight[t][weight[t] > 0], floors.get(i, 0)) for i, t in enumerate(terms)], len(code)))
        return some.mapInArrow(_search(asked, n, max(1, total), b, k), FOUND)

    floors: dict[int, int] = {}
    if n > 2 * SAMPLE:
        sample = index.where(F.pmod(F.xxhash64("id", "n", "term"), F.lit(-(-n // SAMPLE))) == 0)
        floors = {r.item: r.score for r in _within(search(sample, {}), k).where(F.col("rank") == k).collect()}
    names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    return _within(search(index, floors), k).join(F.broadcast(names), "item").select("item_id", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 90, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), id, score: for each item the k documents with the highest scores above 0, ties to the smaller id."""
    rows = items.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_terms_of, "item_id long, term binary")
    rows = settle(rows.distinct(), "item-terms")
    blocks = max(1, -(-rows.count() // TERMS))
    out = None
    for i in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).orderBy(F.asc_nulls_first("item_id"), "term").collect()
        part = _block(docs, own, key, text, k, b)
        out = part if out is None else out.unionByName(part)
    return out
