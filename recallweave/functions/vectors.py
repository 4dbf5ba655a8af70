"""Vector arithmetic as columns: arrays of doubles, evaluated in the JVM."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

TINY = 1e-10


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    """0 where the product of the norms is not above 1e-10, or the lengths differ."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (size <= TINY), 0.0).otherwise(dot(a, b) / size)


def normalize(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.when(size > TINY, F.transform(v, lambda x: x / size)).otherwise(v)


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    return F.transform(v, lambda x: F.exp(x - top) / _sum(F.transform(v, lambda y: F.exp(y - top))))


def rounded(v: Column, digits: int = 6) -> Column:
    """Each component rounded as SQL rounds doubles: half away from zero, and what rounds to zero keeps its sign."""

    def one(x: Column) -> Column:
        r = F.round(x, digits)
        return F.when(r == 0, x * F.lit(0.0)).otherwise(r)

    return F.transform(v, one)


def fit_dimension(v: Column, dim: int) -> Column:
    """Padded with zeros, or cut, to dim components."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dim)), 1, dim)


METRICS = ("cosine", "dot", "euclidean", "manhattan")


def similarity(metric: str, a: Column, b: Column) -> Column:
    """A score that grows with nearness: cosine and dot as they are, distances as 1 / (1 + d)."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    if metric in ("euclidean", "manhattan"):
        return 1 / (1 + (euclidean if metric == "euclidean" else manhattan)(a, b))
    raise ValueError(f"metric must be one of {METRICS}")


def quantized_hash(v: Column) -> Column:
    """A state's name: its components in hundredths, hashed."""
    return F.substring(F.md5(F.array_join(F.transform(v, lambda x: F.round(x * 100).cast("bigint").cast("string")), ",")), 1, 16)


def packed(v: Column) -> Column:
    """Little-endian float32 bytes, by Arrow."""
    @arrow_udf("binary")
    def pack(column: pa.Array) -> pa.Array:
        lists = column.cast(pa.list_(pa.float32()))
        rows = np.asarray(lists.value_lengths().fill_null(0))
        parts = np.asarray(lists.flatten().fill_null(np.nan), "<f4")
        upto = np.concatenate([[0], np.cumsum(rows * 4)]).astype(np.int32)
        known = pa.array(np.asarray(lists.is_valid())).buffers()[1]
        return pa.Array.from_buffers(pa.binary(), len(lists), [known, pa.py_buffer(upto), pa.py_buffer(parts)])

    return pack(v)


def unpacked(b: Column) -> Column:
    """The vector of float32 bytes; what doesn't fill four bytes is dropped."""
    @arrow_udf("array<float>")
    def unpack(column: pa.Array) -> pa.Array:
        size = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
        whole, first = size // 4 * 4, np.cumsum(size) - size
        raw = np.frombuffer(b"".join(column.drop_null().to_pylist()), np.uint8)
        kept = raw if (whole == size).all() else raw[np.arange(len(raw)) - np.repeat(first, size) < np.repeat(whole, size)]
        upto = pa.array(np.concatenate([[0], np.cumsum(whole // 4)]).astype(np.int32))
        return pa.ListArray.from_arrays(upto, pa.array(kept.view("<f4")), mask=column.is_null())

    return unpack(b)


def decoded_rows(rows, blob: str, listed: str):
    """rows with `vector` (doubles) from float32 bytes or else a JSON list; those with neither are dropped."""
    from_list = F.from_json(listed, "array<double>")
    decoded = F.coalesce(unpacked(F.col(blob)).cast("array<double>"), F.when(F.size(from_list) > 0, from_list))
    return rows.withColumn("vector", decoded).where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))


def _places(text: str, dim: int) -> np.ndarray:
    low = text.lower()
    out = np.zeros(dim)
    points = np.frombuffer(low.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(points) >= 3:
        mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out += np.bincount(((mixed >> np.uint64(16)) % np.uint64(dim)).astype(np.int64), minlength=dim)
    words = low.split()
    hashes = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
    pairs = np.array([zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:], strict=False)], np.int64)
    for h, weight in ((hashes, 2.0), (hashes >> 16, 1.0), (pairs, 1.5)):
        if len(h):
            out += weight * np.bincount(h % dim, minlength=dim)
    size = np.linalg.norm(out)
    return out / size if size > TINY else out


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """An embedding without a model: character trigrams weigh 1, words 2 and 1 at two places, word pairs 1.5; normalised.
    One pass over each text in Arrow batches: as JVM expressions, substring() would scan a long text again for
    every trigram."""

    @arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _places(t, dim) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return embed(text)
