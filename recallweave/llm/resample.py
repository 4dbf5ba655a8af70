"""Importance resampling towards a target distribution over hashed word n-grams.

Every run of 1 to n words of a text is a feature and falls in a bucket by its CRC-32. A bucket's gain is the log ratio of its
smoothed shares in the target and in the documents; a document's weight is the mean gain of its features. Adding Gumbel noise
that a hash of the key seeds, the highest scores are a sample without replacement in proportion to exp(weight).

Texts are skewed: one may be as long as a million others. A text over LONG bytes is split at word boundaries into
chunks, each of which owns the features that start in it and carries the n - 1 words after it, so that no feature is lost or counted
twice. Chunks of long texts are dealt to all tasks; short texts are one chunk and are counted where they are read. Counts
by chunk are written once, without texts; bucket totals, and weights by document, are sums over them.

Edge cases: a null or empty text has no features and weight 0; a null key is hashed as no characters; rows of one key
are told apart, each is a document, and equal ones take places in any order; target texts may be null; without documents there are no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, settle
from .terms import KEPT, lists, summed, windows
from .textkit import string_buffers

LONG, CHUNK = 1 << 16, 1 << 15
CHUNKS = "row long, id long, chunk int, own int, body binary"
COUNTED = "row long, id long, words long, features long, bucket array<int>, n array<int>"
_TERM = re.compile(rb"[^ ]+")


def chunks(text: bytes, n: int, size: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(words whose features a chunk owns, its words and the n - 1 that follow) of a text that KEPT has translated."""
    for a, b in windows(text, size):
        end = b
        for _ in range(n - 1):
            found = _TERM.search(text, end)
            if not found:
                break
            end = found.end()
        yield len(text[a:b].split()), text[a:end]


def features(words: list[bytes], own: int, n: int) -> list[bytes]:
    """Runs of 1 to n words that start at one of the first `own`."""
    out = words[:own]
    for k in range(2, n + 1):
        out = out + [b" ".join(words[i : i + k]) for i in range(min(own, len(words) - k + 1))]
    return out


def _split(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, key, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), strict=True):
                for k, (own, body) in enumerate(chunks(text.as_py().encode().translate(KEPT), n)):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([key], pa.int64()), pa.array([k], pa.int32()), pa.array([own], pa.int32()), pa.array([body], pa.binary())], names=[c.split()[0] for c in CHUNKS.split(", ")])

    return run


def _count(n: int, buckets: int):
    """Bucket counts of rows (row, id, text) or (row, id, body, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            split, own = batch.num_columns == 4, None
            if split:
                texts, own = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            else:
                raw, at = string_buffers(batch.column(2))
                whole, at = raw.tobytes().translate(KEPT), at.tolist()
                texts = [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            words, found = np.zeros(rows, np.int64), []
            for i, text in enumerate(texts):
                terms = text.split()
                words[i] = own[i] if split else len(terms)
                found.append(features(terms, int(words[i]), n))
            many = np.array([len(f) for f in found])
            codes = np.fromiter((crc32(x) for f in found for x in f), np.int64, int(many.sum())) % buckets
            key, count = summed(np.repeat(np.arange(rows), many) * buckets + codes)
            by, each = lists(key // buckets, rows, (key % buckets).astype(np.int32), count.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words), pa.array(many.astype(np.int64)), by, each], names=[c.split()[0] for c in COUNTED.split(", ")])

    return run


def bucket_counts(docs: DataFrame, key: str | None, text: str, n: int, buckets: int, long: int = LONG) -> DataFrame:
    """Bucket counts of every chunk of every text (COUNTED): one row for a text of at most `long` bytes, one for each chunk of a longer one."""
    own = F.col(key).cast("long") if key else F.lit(None).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), own.alias("id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > long, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_count(n, buckets), COUNTED)
    dealt = rows.where(is_long).mapInArrow(_split(n), CHUNKS).repartition("row", "chunk")
    return short.unionByName(dealt.select("row", "id", "body", "own").mapInArrow(_count(n, buckets), COUNTED))


def totals(counted: DataFrame) -> DataFrame:
    """bucket, n: the sum over all chunks."""
    one = counted.select(F.explode(F.arrays_zip("bucket", "n")).alias("x"))
    return one.groupBy(F.col("x.bucket").alias("bucket")).agg(F.sum("x.n").alias("n"))


def gains(counted: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket in thousandths, floored: one number for each bucket comes to the driver."""
    s, t = totals(counted).withColumnRenamed("n", "s"), totals(target).withColumnRenamed("n", "t")
    every = counted.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).collect()
    S, T = (F.lit(float(sum(r[c] for r in both) + buckets)) for c in ("s", "t"))
    ratio = ((F.col("t") + 1).cast("double") * S) / ((F.col("s") + 1).cast("double") * T)
    known = counted.sparkSession.createDataFrame(both, "bucket int, s long, t long").select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))
    out = np.zeros(buckets, np.int64)
    for r in known.collect():
        out[r.bucket] = r.gain
    return out


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            by, each = batch.column(4), batch.column(5)
            run_of = np.zeros(len(by.flatten()) + 1, np.int64)
            np.cumsum(gain[np.asarray(by.flatten())] * np.asarray(each.flatten()), out=run_of[1:])
            at = np.asarray(by.offsets) - by.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(run_of[at[1:]] - run_of[at[:-1]])], names=["row", "id", "words", "features", "gain"])

    return run


def gumbel(seed: str, key: F.Column) -> F.Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a digest of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024:", long: int = LONG) -> DataFrame:
    """id, n_words, n_features, weight, score, rank of every document: rank 1, 2, ... for those drawn, `percent` of the documents with
    at least `least_words` words; null for the others."""
    counted = settle(bucket_counts(docs, key, text, n, buckets, long), "bucket-counts")
    aims = settle(bucket_counts(target, None, target_text, n, buckets, long), "target-counts")
    weighed = counted.mapInArrow(_weigh(gains(counted, aims, buckets)), "row long, id long, words long, features long, gain long")
    # One row for each chunk; those of a text meet as sums.
    summed_up = weighed.groupBy("row", "id").agg(F.sum("words").alias("n_words"), F.sum("features").alias("n_features"), F.sum("gain").alias("gain"))
    weight = F.expr("(gain - pmod(gain, greatest(n_features, 1L))) div greatest(n_features, 1L)")  # rounds down
    scored = summed_up.select("id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + gumbel(seed, F.col("id")))
    scored = settle(scored.withColumn("long_enough", F.col("n_words") >= least_words), "scores")
    drawn = scored.where("long_enough").count() * percent // 100
    placed = numbered(scored, [F.desc("long_enough"), F.desc("score"), F.asc_nulls_first("id")], "place")
    return placed.select("id", "n_words", "n_features", "weight", "score", F.when(F.col("long_enough") & (F.col("place") <= drawn), F.col("place")).alias("rank"))
