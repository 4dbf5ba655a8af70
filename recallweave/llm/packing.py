"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Pieces are packed by decreasing size. The open bins stand in order of what is left in them; each carries a
bitmap of the sources and one of the duplicate clusters that it holds. A piece's search starts at the bin
that fits most tightly and goes on to its successors until one is compatible: one without its cluster and
with fewer than `per_source` pieces of its source. If none is, a bin opens.

Pieces are dealt into shards of about `SHARD` by a hash, so a hot source or cluster spreads over all of them;
bins never cross shards, which leaves at most a few open bins in each.

A document with more than `capacity` tokens is cut into pieces: full ones and a rest; pieces of one
document conflict like duplicates.

Edge cases: null and empty texts are pieces of no tokens; a null source or cluster is a value like any other;
repeated rows of one id are told apart by a number within the id.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neardup
from .common import numbered, settle
from .textkit import groups

WORD = r"[^\x20\x09-\x0D]+"
CAPACITY = 2048
SHARD = 2048


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int = 1) -> list[int]:
    """The bin of each piece, numbered as they open. Pieces are taken by decreasing size, ties as they come."""
    source_code = {s: i for i, s in enumerate(dict.fromkeys(sources))}
    cluster_code = {c: i for i, c in enumerate(dict.fromkeys(clusters))}
    room: list[tuple[int, int]] = []  # (what is left, bin), ascending: bins in residual order
    held: list[tuple[int, ...]] = []  # by bin: one bitmap of sources for each of per_source levels
    of_cluster: list[int] = []
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size, s, c = sizes[k], 1 << source_code[sources[k]], 1 << cluster_code[clusters[k]]
        at = bisect_left(room, (size, -1))
        while at < len(room) and (held[room[at][1]][-1] & s or of_cluster[room[at][1]] & c):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
            levels = list(held[b])
            for i, level in enumerate(levels):
                if not level & s:
                    levels[i] = level | s
                    break
            held[b] = tuple(levels)
            of_cluster[b] |= c
        else:
            left, b = capacity, len(held)
            held.append((s, *[0] * (per_source - 1)))
            of_cluster.append(c)
        insort(room, (left - size, b))
        out[k] = b
    return out


PACKED = "shard long, bin long, slot int, doc_id long, copy int, piece int, start long, tokens long, source string"


def _pack(capacity: int, per_source: int):
    def shard(rows) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("copy", "ascending"), ("piece", "ascending"), ("tokens", "ascending"), ("cluster", "ascending")])
        sizes = rows.column("tokens").to_pylist()
        bins = np.array(best_fit(sizes, rows.column("source").to_pylist(), rows.column("cluster").to_pylist(), capacity, per_source), np.int64)
        order = np.lexsort((np.arange(len(bins)), -np.array(sizes), bins))
        ordered = bins[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        slot = np.arange(len(bins)) - np.repeat(first, np.diff(np.append(first, len(bins))))
        t = rows.take(pa.array(order))
        columns = [t.column("shard"), pa.array(ordered), pa.array(slot.astype(np.int32)), t.column("id"), t.column("copy"), t.column("piece"), t.column("start"), t.column("tokens"), t.column("source")]
        return pa.table(columns, names=[c.split()[0] for c in PACKED.split(", ")])

    return shard


def _per_shard(capacity: int, per_source: int):
    """Shards follow each other in sorted rows; one at a time is held."""
    pack = _pack(capacity, per_source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            yield from pack(rows).combine_chunks().to_batches()

    return run


def _near_clusters(docs: DataFrame, key: str, text: str) -> DataFrame:
    """known_id, known_digest (of texts without an id), component: the near copies' clusters. Texts without an id are one
    for each digest and get numbers beside those that are ids."""
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    low, high = named.agg(F.coalesce(F.min("id"), F.lit(0)), F.coalesce(F.max("id"), F.lit(0))).first()
    texts = docs.where(F.col(key).isNull() & F.col(text).isNotNull()).groupBy(F.md5(text).alias("digest")).agg(F.first(text).alias("text"))
    texts = numbered(settle(texts, "unnamed"), [F.col("digest")], "place")
    free = F.lit(high) + F.col("place") if high < 1 << 62 else F.lit(low) - F.col("place")
    texts = settle(texts.select(free.cast("long").alias("id"), "digest", "text"), "numbered")
    found = neardup.near_duplicates(named.unionByName(texts.select("id", "text")), "id", "text").where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias("node")).agg(F.min("component_id").alias("component"))
    known = found.join(texts.select(F.col("id").alias("node"), "digest"), "node", "left")
    return known.select(F.when(F.col("digest").isNull(), F.col("node")).alias("known_id"), F.col("digest").alias("known_digest"), "component")


def pieces(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, near: bool = False) -> DataFrame:
    """id, copy, piece, start (first token), tokens, source, cluster: what is packed. Without a cluster column,
    documents with equal texts are one cluster; with `near`, also those that near copies link."""
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    own = F.col(cluster).cast("string") if cluster else F.md5(F.coalesce(F.col(text), F.lit("")))
    unnamed = F.when(F.col(key).isNull(), F.md5(text))  # a text without an id is known by its digest, never by a number that an id could be
    narrow = docs.select(F.col(key).cast("long").alias("id"), tokens.alias("n"), F.col(source).cast("string").alias("source"), own.alias("cluster"), unnamed.alias("digest"))
    if near:
        same = narrow["id"].eqNullSafe(F.col("known_id")) & narrow["digest"].eqNullSafe(F.col("known_digest"))
        narrow = narrow.join(settle(_near_clusters(docs, key, text), "clusters", docs.count()), same, "left").withColumn("cluster", F.coalesce(F.col("component").cast("string"), "cluster"))
    # Rows of one id are alike but for their number; counting them first keeps a hot id out of one task.
    counted = narrow.groupBy("id", "n", "source", "cluster").agg(F.count("*").cast("int").alias("copies"))
    copied = counted.select("id", "n", "source", "cluster", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / capacity) - 1))
    spread = copied.select("id", "n", "source", "cluster", "copy", F.posexplode(cut).alias("piece", "k"))
    start = F.col("k") * capacity
    return spread.select("id", "copy", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity).cast("long")).alias("tokens"), "source", "cluster")


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = 4, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, shard: int = SHARD, near: bool = False) -> DataFrame:
    """The bin of every piece (shard, bin), its slot there, and what it holds (doc_id, copy, piece, start,
    tokens, source)."""
    rows = settle(pieces(docs, capacity, key, text, source, cluster, near), "pieces", docs.count())
    shards = max(1, -(-rows.count() // shard))
    dealt = rows.select(F.pmod(F.xxhash64("id", "copy", "piece"), F.lit(shards)).cast("long").alias("shard"), "*").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(_per_shard(capacity, per_source), PACKED)
