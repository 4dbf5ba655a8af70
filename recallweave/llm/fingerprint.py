"""Document fingerprints by locally consistent parsing.

A text's code points are cut into phrases by deterministic coin tossing: runs of one symbol collapse, the
lowest bit in which a symbol differs from its left neighbour becomes its label, four such rounds leave
labels of a few values, and a phrase begins at each local maximum of them. Phrases get names by hashing
what they hold, and the sequence of names is parsed again, level upon level, until one name is left.
Where a phrase begins depends on a few neighbouring symbols only, so equal substrings get equal phrases
inside, wherever they stand. The fingerprint keeps the smallest hashes of the names whose phrases span
at least `MIN_SPAN` code points, and of the root.

Edge cases: a null text is the empty text, whose fingerprint has no hashes; two empty fingerprints are
alike (1.0), an empty and another are not (0.0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, settle
from .textkit import BLOCK_BYTES, U64, code_points, constants, mix, string_buffers

MIN_SPAN = 8
SIZE = 64
_BLOCK = BLOCK_BYTES // 4
_PLACE = constants(4096, 41)
_SEED = constants(4, 43)
#: Position of the lowest set bit of small numbers.
_LOW = np.array([0] + [(i & -i).bit_length() - 1 for i in range(1, 256)], np.uint8)


#: Symbols that are labelled and named at a time, so temporary arrays don't grow with a text.
_PART = 1 << 17
_ROUNDS = 4


def _labels(symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels from four rounds of deterministic coin tossing; at `first` there is no left neighbour. A label depends on
    as many symbols to the left as there are rounds, so parts that overlap by these give the same labels."""
    out = np.empty(len(symbol), np.uint8)
    for a in range(0, len(symbol), _PART):
        low, b = max(0, a - _ROUNDS), min(a + _PART, len(symbol))
        out[a:b] = _toss(symbol[low:b], first[np.searchsorted(first, low) : np.searchsorted(first, b)] - low)[a - low :]
    return out


def _toss(symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    left = symbol.copy()
    left[1:] = symbol[:-1]
    left[first] = ~symbol[first]
    differ = symbol ^ left
    at = np.bitwise_count((differ & (~differ + U64(1))) - U64(1)).astype(np.uint8)
    label = (at << 1) | ((symbol >> (at & 63).astype(U64)) & U64(1)).astype(np.uint8)
    for _ in range(_ROUNDS - 1):
        near = label.copy()
        near[1:] = label[:-1]
        near[first] = label[first] ^ 1
        at = _LOW[label ^ near]
        label = (at << 1) | ((label >> at) & 1)
    return label


def _level(symbol: np.ndarray, span: np.ndarray | None, doc: np.ndarray, level: int):
    """The next level's (symbols, spans, documents); without spans each symbol is one code point."""
    n = len(symbol)
    head = np.ones(n, bool)
    head[1:] = (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(head)
    length = np.diff(np.append(run, n))
    symbol = symbol[run]
    for a in range(0, len(run), _PART):
        b = a + _PART
        symbol[a:b] = mix(symbol[a:b] + length[a:b].astype(U64) * _SEED[0] + U64(level))
    span = length.astype(np.int32) if span is None else np.add.reduceat(span, run)
    doc = doc[run]
    del head, run, length
    n = len(symbol)
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    label = _labels(symbol, np.flatnonzero(first)).astype(np.int16)
    before, after = np.empty_like(label), np.empty_like(label)
    before[1:], before[0] = label[:-1], 0
    after[:-1], after[-1] = label[1:], -1
    after[:-1][first[1:]] = -1
    starts = np.flatnonzero(first | ((label > before) & (label >= after)))
    edge = np.append(starts, n)
    name = np.empty(len(starts), U64)
    for a in range(0, len(starts), _PART):
        at = edge[a : a + _PART + 1]
        size = np.diff(at)
        place = np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], size)
        name[a : a + _PART] = mix(np.add.reduceat(symbol[at[0] : at[-1]] * _PLACE[place % len(_PLACE)], at[:-1] - at[0]) + size.astype(U64) * _SEED[1])
    return name, np.add.reduceat(span, starts), doc[starts]


def phrase_names(raw: np.ndarray, at: np.ndarray, min_span: int = MIN_SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, spans, document index) of the kept phrases of all levels of a block's texts."""
    points, offsets = code_points(raw, at)
    symbol = points.astype(U64)
    del points
    for a in range(0, len(symbol), _PART):
        symbol[a : a + _PART] = mix(symbol[a : a + _PART] + _SEED[2])
    span = None  # one code point each
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(offsets))
    kept = []
    level = 0
    while len(symbol):
        level += 1
        alone = np.ones(len(doc), bool)
        alone[1:] &= doc[1:] != doc[:-1]
        alone[:-1] &= doc[1:] != doc[:-1]
        kept.append((symbol[alone], np.ones(np.count_nonzero(alone), np.int32) if span is None else span[alone], doc[alone]))  # roots
        if alone.any():
            symbol, span, doc = symbol[~alone], None if span is None else span[~alone], doc[~alone]
            if not len(symbol):
                break
        symbol, span, doc = _level(symbol, span, doc, level)
        wide = span >= min_span
        kept.append((symbol[wide], span[wide], doc[wide]))
    if not kept:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def fingerprints(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """For each whole UTF-8 text its `size` smallest phrase hashes, ascending 32-bit values."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= _BLOCK):
            total += len(texts[j])
            j += 1
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])]).astype(np.int64)
        name, _, doc = phrase_names(np.frombuffer(b"".join(texts[i:j]), np.uint8), at)
        key = np.unique((doc.astype(U64) << U64(32)) | (mix(name ^ _SEED[3]) >> U64(32)))
        owner = (key >> U64(32)).astype(np.int64)
        start = np.searchsorted(owner, np.arange(j - i + 1))
        low = key.astype(np.uint32)
        out += [low[a : min(b, a + size)] for a, b in zip(start[:-1], start[1:], strict=True)]
        i = j
    return out


def encode(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of phrases in common, 2 |A & B| / (|A| + |B|), from the Jaccard likeness that shows
    in the smallest hashes of both together."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:] == both[:-1]
    distinct = np.concatenate([[True], ~same])
    take = min(size, int(distinct.sum()))
    last = both[np.flatnonzero(distinct)[take - 1]]
    jaccard = np.count_nonzero(both[1:][same] <= last) / take
    return float(2 * jaccard / (1 + jaccard))


def fingerprint_column(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """df with the encoded fingerprint of each whole text."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        raw, at = string_buffers(texts)
        data = raw.tobytes()
        return pa.array([encode(x) for x in fingerprints([data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])], pa.string())

    return df.withColumn(name, of(F.col(text)))


def _cut(text: bytes, points: int) -> int:
    """The byte offset of a code point."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return int(starts[points]) if points < len(starts) else len(text)


def _length(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def edited_text(text: bytes, following: bytes) -> bytes:
    """The last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    n = _length(text)
    return text[: _cut(text, n - n // 2)] + following[: _cut(following, n // 2)]


EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Bytes of text in a range, and ranges at most: beyond that ranges grow, and their sort spills.
RANGE_BYTES, RANGES = 8 << 20, 50_000
_LAST = (1 << 63) - 1


def _longs(values) -> F.Column:
    """A constant array, made in one call."""
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast("array<long>")


def _places(spark, n: int) -> list[int]:
    """For each of n partitions a number that hash partitioning deals to it."""
    if n == 1:
        return [0]
    tried = spark.range(int(n * (np.log(n) + 30))).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
    found = dict(tried.collect())  # n rows
    return [found.get(p, p) for p in range(n)]


def edit_probe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text, and its edited text: its tail replaced by the head of the next document in
    descending key order (after the last: the first). Rows with equal keys follow each other by a hash of the text and
    then the text; null keys come last (with the key -2**63, which they tie with). Rows with equal keys and texts are worked out once and given as often as
    they stand there.

    The order (key, hash of text) is cut into ranges of about RANGE_BYTES, so a key that very many rows share is cut too. Every range gets the
    next range's first row as a sentinel, so each row meets its successor inside one sorted stream and no
    task reads more than its range; each range has a partition of its own."""
    spark = docs.sparkSession
    bounded_batches(spark)
    k = F.col(key).cast("long")
    rows = docs.select(k.alias("k"), F.coalesce(F.bitwise_not(k), F.lit(_LAST)).alias("o"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    narrow = settle(rows.select("o", "h", F.octet_length("t").alias("n")), "order")
    size = narrow.agg(F.sum("n")).first()[0]
    if size is None:
        return spark.createDataFrame([], EDIT_SCHEMA)
    again = narrow.groupBy("o", "h").count().where("count > 1").select("o", "h")
    if again.limit(1).count():
        again = settle(again, "again")
        multiple = rows.join(again, ["o", "h"]).groupBy("k", "o", "h", "t").agg(F.count("*").alias("c"))
        rows = rows.join(again, ["o", "h"], "left_anti").select("k", "o", "h", "t", F.lit(1).cast("long").alias("c")).unionByName(multiple)
    else:
        rows = rows.withColumn("c", F.lit(1).cast("long"))
    n = min(RANGES, max(1, -(-size // RANGE_BYTES)))
    dealt = narrow.select("o", "h").repartitionByRange(n, "o", "h")
    heads = sorted((r.o, r.h) for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("o", "h")).alias("x")).select("x.*").collect())  # one row for each range
    heads = heads[:: -(-len(heads) // n)]
    n = len(heads)
    first_o, first_h = _longs(x[0] for x in heads), _longs(x[1] for x in heads)

    def step(at, s):  # binary search for the last range that begins at or before the row
        o, h = F.get(first_o, at + s), F.get(first_h, at + s)
        return F.when((o < F.col("o")) | ((o == F.col("o")) & (h <= F.col("h"))), at + s).otherwise(at)

    steps = [1 << i for i in reversed(range(max(1, n.bit_length())))]
    rows = rows.withColumn("b", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step))
    ends = spark.range(1).select(F.posexplode(F.arrays_zip(first_o.alias("so"), first_h.alias("sh"))).alias("i", "x")).select("x.so", "x.sh", F.pmod(F.col("i") - 1, F.lit(n)).alias("sto"))
    copies = rows.join(F.broadcast(ends), (F.col("o") == F.col("so")) & (F.col("h") == F.col("sh"))).select("k", "o", "h", "t", F.col("sto").alias("b"), "c", F.lit(1).alias("f"))
    placed = rows.select("k", "o", "h", "t", "b", "c", F.lit(0).alias("f")).unionByName(copies).withColumn("place", F.get(_longs(_places(spark, n)), F.col("b")))
    ordered = placed.repartition(n, "place").sortWithinPartitions("b", "f", "o", "h", "t")
    return ordered.select("k", "t", "b", "f", "c").mapInArrow(_walk, EDIT_SCHEMA)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last row so far: key, text, range, is sentinel, times, fingerprint
    for batch in batches:
        keys, where, flag, times = batch.column(0).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
        raw, at = string_buffers(batch.column(1))
        step = 0
        while step < len(keys):
            stop = max(step + 1, int(np.searchsorted(at, at[step] + 4 * BLOCK_BYTES, "right")) - 1)
            data = raw[at[step] : at[stop]].tobytes()
            cut = at[step : stop + 1] - at[step]
            rows = [held] if held else []
            rows += [(keys[i], data[cut[i - step] : cut[i - step + 1]], where[i], flag[i], times[i], None) for i in range(step, stop)]
            step = stop
            # A sentinel counts only where it directly follows the last row of its range.
            rows = [r for i, r in enumerate(rows) if not r[3] or i == 0 or not (rows[i - 1][3] and rows[i - 1][2] == r[2])]
            prints = fingerprints([r[1] for r in rows[held is not None :]])
            prints = ([held[5]] if held else []) + prints
            # (row, its successor, how often): all but the last of equal rows follow each other.
            pairs = [(i, i, int(r[4]) - 1) for i, r in enumerate(rows) if not r[3] and r[4] > 1 and (i or not held)]
            pairs += [(i, i + 1, 1) for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
            edits = [edited_text(rows[i][1], rows[j][1]) for i, j, _ in pairs]
            changed = fingerprints(edits)
            if pairs:
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows[i][0] for i, _, _ in pairs], pa.int64()),
                        pa.array([_length(rows[i][1]) for i, _, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in edits]),
                        pa.array([encode(prints[i]) for i, _, _ in pairs]),
                        pa.array([encode(c) for c in changed]),
                        pa.array([likeness(prints[i], c) for (i, _, _), c in zip(pairs, changed, strict=True)], pa.float64()),
                        pa.array([likeness(prints[i], prints[j]) for i, j, _ in pairs], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                often = np.array([c for _, _, c in pairs])
                yield out
                for a in range(1, int(often.max()), 1000):  # further copies, some at a time
                    more = np.clip(often - a, 0, 1000)
                    for one in np.flatnonzero(more):
                        yield out.take(pa.array(np.full(more[one], one)))
            held = (*rows[-1][:5], prints[-1])
