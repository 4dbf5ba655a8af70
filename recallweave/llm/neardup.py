"""Near-duplicate documents by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Every distinct shingle set has a signature of `TREES` sequences of `DEPTH` minima: `TREES` sorted orders. Two
sets are candidates where they share a prefix of `BASE` minima in some order; at a Jaccard likeness of
0.85 a pair escapes all of them with a probability of about 1e-5, at 0.8 of 2e-4. Depth adapts by region: where more
than `BLOCK` sets share a prefix, each set goes down to the shortest longer prefix that no more than `BLOCK` share; what is crowded at `DEPTH` minima still is dealt into blocks.
Within a block the sets stand in the sorted order of its tree, and the lengths of the common prefixes of neighbours span a tree
of regions. Candidates come from the longest common prefixes first, then from ever shorter ones: two sets are compared where their
common prefix ends, unless they are joined already, and, sketch and size permitting, on their full sets.

Pairs that depth or blocks kept apart in a crowded prefix are found exactly in a second round. If at most `BLOCK` sets stand
outside the prefix's largest component, they meet all of it in pairs of blocks. If more do, as where a boilerplate
is common to texts that aren't alike, linked sets must share one of their rarest shingles: the sets meet by these (n - ceil(0.85 n) + 1 of n
at 0.85, by their number in such regions), so the boilerplate itself brings nobody together. So no bound on a region
loses a link; the cuts only decide where it is found.

Only links that join components leave a block, never all pairs of a group.

Edge cases: a null or blank text has the empty set and is linked with nothing. Rows that share an id are one
node: each of their sets is compared, and the sets of an id are one component. Rows with a null id take no part: their component is null and they are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTES_A_FILE, in_files, maybe_in, one_of_equal, settle
from .components import components
from .textkit import BLOCK_BYTES, U64, blocks, constants, groups, mix, shingle_hashes

TREES, BASE, DEPTH = 12, 3, 6
#: Sets in a block, and shingles in it, at most (in expectation).
BLOCK, BLOCK_SHINGLES = 2048, 4 << 20
_FLIP, _TURN = constants(TREES * DEPTH, 71), constants(TREES * DEPTH, 73)


def _distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles in ascending order, and their offsets."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(offsets) - 1))]).astype(np.int64)


SIGNATURE = "id long, written long, n long, set_a long, set_b long, base array<long>, sketch binary"


def _sign(words_in_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in blocks(batch.column(1), BLOCK_BYTES // 2):
                values, offsets = _distinct(*shingle_hashes(raw, at, words_in_shingle))
                size = np.diff(offsets)
                some = np.flatnonzero(size)
                starts = offsets[:-1][some]
                least = np.zeros((j - i, TREES * DEPTH), np.uint32)
                sums = np.zeros((j - i, 2), U64)
                base = np.zeros((j - i, TREES), U64)
                if len(some):
                    for k in range(TREES * DEPTH):
                        least[some, k] = np.minimum.reduceat((values ^ _FLIP[k]) * _TURN[k], starts) >> U64(32)
                    for k in range(2):
                        sums[some, k] = np.add.reduceat(mix(values ^ _FLIP[k]), starts)
                    for t in range(TREES):
                        key = np.full(len(some), t + 1, U64)
                        for k in range(BASE):
                            key = mix(key + least[some, t * DEPTH + k])
                        base[some, t] = key
                keys = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * TREES), pa.array(base.view(np.int64).reshape(-1)))
                sketch = (least & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(2)[i:j], pa.array(size), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), keys, pa.array([s.tobytes() for s in sketch], pa.binary())],
                    names=["id", "written", "n", "set_a", "set_b", "base", "sketch"],
                )

    return run


#: Of the sketch's 72 places, those that must agree: far below what 0.8 lets expect, 57.6 +- 3.4.
_AGREE = 40


class _Block:
    """The sets that meet in one block, and which of their pairs are still to be compared."""

    def __init__(self, rows: pa.Table, percent: int):
        self.percent = percent
        self.tree = rows.column("tree")[0].as_py()
        self.id = np.asarray(rows.column("id").combine_chunks())
        self.n = np.asarray(rows.column("n").combine_chunks())
        self.label = np.asarray(rows.column("label").combine_chunks()).copy()
        self.sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(self.id), -1)
        keys = np.zeros((len(self.id), TREES), np.int64)
        if self.tree >= 0:
            for i, x in enumerate(rows.column("keys").to_pylist()):
                for k in x:
                    keys[i, k["tree"]] = k["block"]
        self.earlier = keys[:, : max(self.tree, 0)]

    def partners(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of the others, those that must be compared with i here and can be linked with it."""
        o = others[self.label[others] != self.label[i]]
        small, large = np.minimum(self.n[o], self.n[i]), np.maximum(self.n[o], self.n[i])
        o = o[100 * small >= self.percent * large]
        o = o[np.count_nonzero(self.sketch[o] == self.sketch[i], axis=1) >= _AGREE]
        # Pairs that share a block of an earlier order are compared there.
        return o[~((self.earlier[o] == self.earlier[i]) & (self.earlier[i] != 0)).any(axis=1)]

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """(a set, those after it in this tree's sorted order that its common prefix with first ends at this length), from
        the longest prefixes to the shortest. Each pair comes once. In the second round the first tree's order serves."""
        first = max(self.tree, 0) * DEPTH
        order = np.lexsort(np.roll(self.sketch, -first, axis=1).T[::-1])
        own = self.sketch[order, first : first + DEPTH]
        common = np.cumprod(own[1:] == own[:-1], axis=1).sum(axis=1)  # the longest common prefix of neighbours
        place = np.arange(len(order))
        inner = place + 1  # where the region of the next longer prefix ends
        for length in range(DEPTH, -1, -1):
            ends = np.append(np.flatnonzero(common < length) + 1, len(order))
            outer = ends[np.searchsorted(ends, place, "right")]
            for i in np.flatnonzero(outer > inner):
                yield order[i], order[inner[i] : outer[i]]
            inner = outer


def _take_part(percent: int):
    """Rows of sets that have a partner to be compared with in their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            if rows.num_rows < 2:
                continue
            block = _Block(rows, percent)
            part = np.zeros(rows.num_rows, bool)
            for i in range(rows.num_rows - 1):
                found = block.partners(i, np.arange(i + 1, rows.num_rows))
                if len(found):
                    part[i] = True
                    part[found] = True
            if part.any():
                yield from rows.filter(pa.array(part)).combine_chunks().to_batches()

    return run


def _link(words_in_shingle: int, percent: int):
    """Links that join the components of each block, confirmed on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            if rows.num_rows < 2:
                continue
            block = _Block(rows, percent)
            values, sizes = [], []
            for _, _, raw, at in blocks(rows.column("text").combine_chunks()):
                v, o = _distinct(*shingle_hashes(raw, at, words_in_shingle))
                values.append(v)
                sizes.append(np.diff(o))
            size = np.concatenate(sizes)
            ends = np.cumsum(size)
            starts = ends - size
            vocabulary, word = np.unique(np.concatenate(values), return_inverse=True)
            mark = np.zeros(len(vocabulary), bool)
            links = []

            def compare(i: int, others: np.ndarray):
                if not len(others):
                    return
                mark[word[starts[i] : ends[i]]] = True  # noqa: B023
                at = np.cumsum(size[others])  # noqa: B023
                spread = np.repeat(starts[others] - (at - size[others]), size[others]) + np.arange(at[-1])  # noqa: B023
                shared = np.add.reduceat(mark[word[spread]], at - size[others], dtype=np.int64)  # noqa: B023
                mark[word[starts[i] : ends[i]]] = False  # noqa: B023
                for j in others[100 * shared >= percent * (size[i] + size[others] - shared)]:  # noqa: B023
                    if block.label[i] != block.label[j]:  # noqa: B023
                        links.append((block.id[i], block.id[j]))  # noqa: B023
                        block.label[block.label == block.label[j]] = block.label[i]  # noqa: B023

            for i, others in block.candidates():
                compare(i, block.partners(i, others))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return run


BLOCK_ROW = "block long, tree int, id long, n long, label long, sketch binary, keys array<struct<tree:int,block:long>>, rep long, written long"


#: Sets with their texts that one task compares.
TEXTS_A_TASK = 4000


def _able(rows: DataFrame, n: int | None, percent: int) -> DataFrame:
    """Of rows (n at most) of blocks, those of sets that have a partner to be compared with."""
    order = [c.split()[0] for c in BLOCK_ROW.replace("tree:int,", "").split(", ")]
    return settle(rows.select(*order).repartition("block").sortWithinPartitions("block").mapInArrow(_take_part(percent), BLOCK_ROW), "blocks", n)


def _compare(able: DataFrame, texts: DataFrame, words_in_shingle: int, percent: int) -> DataFrame:
    """Links (a, b) inside the blocks of `able`, confirmed on the texts."""
    ready = able.join(texts, ["rep", "written"]).select(*able.columns, "text").repartition("block").sortWithinPartitions("block")
    return settle(ready.mapInArrow(_link(words_in_shingle, percent), "a long, b long"), "near", able.count(), TEXTS_A_TASK)


def _fetch(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of texts whose (rep, written) are in keys, written once for both rounds. Those that a Bloom filter of the keys
    doesn't know aren't shuffled."""
    keys = settle(keys.distinct(), "keys")
    return settle(maybe_in(texts, "rep", keys).join(keys, ["rep", "written"], "left_semi").select("rep", "written", "text"), "texts")


def _nodes(sets: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """set_a, set_b, rep, node: the node of a set is its smallest id, and where ids are shared by several sets a hash, with a seed that
    makes all nodes distinct; and whether there are such ids."""
    odd = sets.groupBy("rep").count().where("count > 1").select("rep")
    if not odd.limit(1).count():
        return sets.withColumn("node", F.col("rep")), False
    odd = settle(odd.withColumn("shared", F.lit(True)), "shared")
    for seed in range(100):
        named = settle(sets.join(odd, "rep", "left").select("set_a", "set_b", "rep", F.when(F.col("shared"), F.xxhash64("rep", "set_a", "set_b", F.lit(seed))).otherwise(F.col("rep")).alias("node")), "nodes", n)
        if not named.groupBy("node").count().where("count > 1").limit(1).count():
            return named, True
    raise ValueError("no seed gives distinct nodes")


def _regions(leaders: DataFrame, n: int, block: int) -> DataFrame:
    """node, tree, base, over, block of every set that shares a prefix with another: its region at the depth that fits."""
    over = F.ceil(F.greatest(F.col("c") / block, F.col("s") / BLOCK_SHINGLES)).cast("int")
    count = lambda df, by: df.groupBy(by).agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    slim = leaders.select("node", "n", "sketch", F.posexplode("base").alias("tree", "base"))
    slim = slim.select("node", "n", "tree", "base", F.substring("sketch", F.col("tree") * DEPTH + BASE + 1, F.lit(DEPTH - BASE)).alias("rest"))
    near = settle(slim.join(count(slim, "base").where("c > 1"), "base").select("node", "n", "tree", "base", "rest", over.alias("over")), "regions", TREES * n)
    prefix = lambda depth: F.xxhash64("base", F.substring("rest", F.lit(1), depth))
    crowded = near.where("over > 1")
    longer = crowded.select("node", "n", "tree", "base", "rest", F.explode(F.sequence(F.lit(1), F.lit(DEPTH - BASE))).alias("depth")).withColumn("prefix", prefix(F.col("depth")))
    sizes = settle(count(longer, "prefix").select("prefix", over.alias("parts")), "prefixes", (DEPTH - BASE) * crowded.count())
    fit = longer.join(sizes, "prefix").groupBy("node", "tree", "base", "rest").agg(F.min(F.when(F.col("parts") == 1, F.col("depth"))).alias("depth"), F.max(F.when(F.col("depth") == DEPTH - BASE, F.col("parts"))).alias("parts"))
    dealt = F.xxhash64(prefix(F.lit(DEPTH - BASE)), F.pmod(F.xxhash64("node"), F.col("parts")))
    deep = fit.select("node", "tree", "base", F.lit(2).alias("over"), F.when(F.col("depth").isNotNull(), prefix(F.col("depth"))).otherwise(dealt).alias("block"))
    return near.where("over = 1").select("node", "tree", "base", "over", F.col("base").alias("block")).unionByName(deep)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words_in_shingle: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs: linked are documents whose sets of word
    shingles have 100 * intersection >= percent * union (percent should be 80 or more: the forest's depth
    is chosen for that)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("written"))
    signed = settle(rows.mapInArrow(_sign(words_in_shingle), SIGNATURE), "signatures")
    usable = signed.where("n > 0 and id is not null")
    n = signed.count()
    # Written, not reused: a join straight above the aggregate couldn't split a set that very many documents share.
    sets = settle(usable.groupBy("set_a", "set_b").agg(F.min("id").alias("rep")), "sets", n)
    sets, shared = _nodes(sets, n)
    members = settle(usable.select("id", "set_a", "set_b").join(sets, ["set_a", "set_b"]).select("id", "node"), "members", n)
    # One row for each set; of the texts that have it under its smallest id, one stands for it.
    leaders = usable.join(sets.withColumnRenamed("rep", "id"), ["id", "set_a", "set_b"]).dropDuplicates(["node"])
    leaders = settle(leaders.select("node", F.col("id").alias("rep"), "written", "n", "base", "sketch"), "leaders", n)
    texts = one_of_equal(rows.where("id is not null").select(F.col("id").alias("rep"), "written", "text"), "rep", "written", "text")

    placed = settle(_regions(leaders, n, block), "placed", TREES * n)
    homes = placed.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("tree", "block"))).alias("keys"))  # at most TREES each
    payload = leaders.select("node", "n", "sketch", "rep", "written").join(homes, "node")
    met = payload.select(F.col("node").alias("id"), "n", F.col("node").alias("label"), "sketch", "keys", "rep", "written", F.explode("keys").alias("k")).select("*", "k.tree", "k.block")
    able = _able(met, TREES * n, percent)
    crowded = placed.where("over > 1")
    texts = _fetch(texts, able.select("rep", "written").unionByName(leaders.join(crowded.select("node").distinct(), "node").select("rep", "written")))
    links = _compare(able, texts, words_in_shingle, percent)
    if shared:  # the sets of an id are one node
        least = members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("id", "a")
        links = settle(links.unionByName(members.join(settle(least, "least", n), "id").select("a", F.col("node").alias("b"))), "near", n)
    found = components(links)
    if crowded.limit(1).count():
        links = settle(links.unionByName(_second_round(crowded, TREES * n, leaders, found, texts, words_in_shingle, percent, block)), "near", n)
        found = components(links)
    rep = members.join(found.withColumnRenamed("id", "node"), "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    if shared:  # nodes are not all ids
        rep = settle(rep, "found", n)
        rep = rep.join(settle(rep.groupBy("component").agg(F.min("id").alias("least")), "least", n), "component").select("id", F.col("least").alias("component"))
    rep = rep.groupBy("id").agg(F.min("component").alias("component"))
    out = signed.select("id", "n").join(rep, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the smallest id. Of rows that
    share an id the one with the smallest text stays; rows without an id stay."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    gone = near_duplicates(docs, key, text, **how).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    left = in_files(docs.join(gone, key, "left_anti").select(*docs.columns), size, BYTES_A_FILE)
    again = docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    if not again.limit(1).count():
        return left
    again = settle(again, "again")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(text))
    chosen = left.join(again, key, "left_semi").withColumn("__rw_rank", rank).where("__rw_rank = 1").drop("__rw_rank")
    return left.join(again, key, "left_anti").unionByName(chosen).select(*docs.columns)


def _shape(rows: DataFrame) -> DataFrame:
    """group, main (its largest component), m (sets in it), outside (all others), from rows of group, node, label."""
    sizes = rows.groupBy("group", "label").agg(F.count("*").alias("c"))
    largest = F.max_by("label", F.struct("c", "label"))
    return sizes.groupBy("group").agg(largest.alias("main"), F.max("c").alias("m"), F.sum("c").alias("all")).where("all > m").select("group", "main", "m", (F.col("all") - F.col("m")).alias("outside"))


def _pairs_of_blocks(rows: DataFrame, shape: DataFrame, block: int) -> DataFrame:
    """node, label, block: those outside the largest component of a group meet all of it, in pairs of half blocks."""
    half = max(1, block // 2)
    shape = shape.select("group", "main", F.ceil(F.col("m") / half).cast("int").alias("q"), F.ceil(F.col("outside") / half).cast("int").alias("p"))
    dealt = rows.join(shape, "group").withColumn("out", F.col("label") != F.col("main"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.when(F.col("out"), F.col("p")).otherwise(F.col("q"))).cast("int"))
    pair = lambda kind, i, j: F.xxhash64("group", F.lit(kind), i, j)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    others = F.transform(upto(F.col("p")), lambda j: pair("out", F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    blocks_of = F.when(F.col("out"), F.array_union(others, F.transform(upto(F.col("q")), lambda j: pair("main", F.col("own"), j)))).otherwise(F.transform(upto(F.col("p")), lambda j: pair("main", j, F.col("own"))))
    return dealt.select("node", "label", F.explode(blocks_of).alias("block"))


def _shingles(words_in_shingle: int):
    """node, label, n, group: every distinct shingle of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in blocks(batch.column(3), BLOCK_BYTES // 2):
                values, offsets = _distinct(*shingle_hashes(raw, at, words_in_shingle))
                own = pa.array(np.repeat(np.arange(j - i), np.diff(offsets)))
                yield pa.RecordBatch.from_arrays([*[batch.column(k)[i:j].take(own) for k in range(3)], pa.array(values.view(np.int64))], names=["node", "label", "n", "group"])

    return run


def _second_round(crowded: DataFrame, n: int, leaders: DataFrame, found: DataFrame, texts: DataFrame, words_in_shingle: int, percent: int, block: int) -> DataFrame:
    """Links between sets of a crowded prefix that the first round didn't compare."""
    rows = crowded.join(found.withColumnRenamed("id", "node"), "node", "left").select("node", F.col("base").alias("group"), F.coalesce("component", "node").alias("label"))
    shape = settle(_shape(rows), "shapes", n)
    met = _pairs_of_blocks(rows, shape.where(F.col("outside") <= block), block)
    wide = shape.where(F.col("outside") > block).select("group")
    if wide.limit(1).count():
        apart = rows.join(wide, "group", "left_semi").select("node", "label").distinct().join(leaders.select("node", "n", "rep", "written"), "node")
        apart = settle(apart, "apart", n).join(texts, ["rep", "written"]).select("node", "label", "n", "text")
        postings = settle(apart.mapInArrow(_shingles(words_in_shingle), "node long, label long, n long, group long"), "postings")
        often = settle(postings.groupBy("group").agg(F.count("*").alias("often"), F.min("label").alias("a"), F.max("label").alias("b")), "often")
        # Linked sets share one of the rarest n - ceil(percent n) + 1 shingles of each, in any one order of all shingles.
        rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "group"))
        least = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        rarest = settle(postings.join(often, "group").withColumn("rank", rank).where((F.col("rank") <= least) & (F.col("a") < F.col("b"))).select("node", "label", "group"), "rarest")
        met = met.unionByName(_pairs_of_blocks(rarest, settle(_shape(rarest), "shapes"), block))
    none = F.array().cast("array<struct<tree:int,block:long>>")
    payload = leaders.select("node", "n", "sketch", "rep", "written")
    ready = met.join(payload, "node").select("block", F.lit(-1).alias("tree"), F.col("node").alias("id"), "n", "label", "sketch", none.alias("keys"), "rep", "written")
    return _compare(_able(ready, None, percent), texts, words_in_shingle, percent)
