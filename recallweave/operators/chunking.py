"""Chunks of texts: overlapping windows of words, and paragraphs up to a number of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, words


def windows(w: Column, size: int, overlap: int) -> Column:
    """The array of chunks of an array of words: `size` words each, `overlap` of them shared with the one before. The words must be a column of their own: an expression
    would be worked out again for each chunk."""
    n = F.size(w)
    step = max(size - overlap, 1)
    last = F.when(n == 0, F.lit(-1)).when(n <= size, F.lit(0)).otherwise(F.floor((n - overlap // 2 - 1) / step)).cast("int")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(w, k * step + 1, F.lit(size)), " ")))


def chunk(df: DataFrame, text: str, size: int = 512, overlap: int = 128, most: int | None = None) -> DataFrame:
    """df's other columns, chunk_index (from 0) and chunk; texts without words give no row. A text is split once, and chunks beyond `most` are not made."""
    rest = [c for c in df.columns if c != text]
    name = "__rw_words"
    split = df.select(*rest, words(F.col(text)).alias(name))
    if most is not None:  # of these words the first `most` chunks are made, and one more, which goes
        split = split.withColumn(name, F.slice(name, 1, max(size - overlap, 1) * most + size))
    rows = split.select(*rest, F.posexplode(windows(F.col(name), size, overlap)).alias("chunk_index", "chunk"))
    rows = rows.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))
    return rows if most is None else rows.where(F.col("chunk_index") < most)


def paragraphs(text: Column, most: int) -> Column:
    """Paragraphs joined while together they have at most `most` words."""
    count = lambda t: F.size(F.filter(F.split(t, SPACE + "+"), lambda w: w != ""))
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        full = (s["cur"] != "") & (count(s["cur"]) + count(p) > most)
        joined = F.when(s["cur"] == "", p).otherwise(F.concat(s["cur"], F.lit("\n\n"), p))
        return F.struct(F.when(full, p).otherwise(joined).alias("cur"), F.when(full, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]).alias("out"))

    parts = F.filter(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, SPACE, "") != "")
    return F.aggregate(parts, start, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))))
