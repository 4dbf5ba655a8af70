"""An inverted index of words with positions, and text search that reads it and never the texts.

A posting is (slot, word, the key columns, field, positions). Slots are folders by a hash of the word, so a search for whole words
reads their slots alone, and the word reaches the scan as a filter. A needle is found as `contains` finds it in the words of a
text joined by single blanks: its first word may be the end of one, its last the beginning of one, a single one any part; which words
those are is looked up in the dictionary (a row for each distinct word). Several words are joined by position.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import text as texts

SLOTS = 32


def slot_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def _placed(words: Column) -> Column:
    """Each distinct word of an array with its places in ascending order, by Arrow."""
    @arrow_udf("array<struct<word string, positions array<int>>>")
    def place(column: pa.Array) -> pa.Array:
        n = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
        coded = column.flatten().dictionary_encode()
        code, row = np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(len(n)), n)
        at = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((code, row))  # stable, so places stay in order
        code, row, at = code[order], row[order], at[order]
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))) if len(code) else np.zeros(0, np.int64)
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(at.astype(np.int32)))
        found = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code[first])), places], names=["word", "positions"])
        upto = np.append(0, np.cumsum(np.bincount(row[first], minlength=len(n)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(upto), found)

    return place(words)


def postings(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """slot, word, keys, field, positions: the lower-case words of each field of each row, found row by row without a shuffle. Write it by slot, sorted by word, before searching it."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f)).alias("body")) for f in fields]))
    split = rows.select(*keys, each.alias("x")).select(*keys, F.col("x.field").alias("field"), texts.words(F.coalesce("x.body", F.lit(""))).alias("words"))
    found = split.select(*keys, "field", F.explode(_placed(F.col("words"))).alias("x"))
    return found.select(slot_of(F.col("x.word")).alias("slot"), "x.word", *keys, "field", "x.positions")


def by_slot(found: DataFrame) -> DataFrame:
    """Postings dealt and sorted as they are written: a slot goes to as many tasks as its size asks for, so none holds all of a frequent word."""
    return found.hint("rebalance", "slot").sortWithinPartitions("slot", "word")


def dictionary(index: DataFrame) -> DataFrame:
    """slot, word, rows: each distinct word of an index."""
    return index.groupBy("slot", "word").agg(F.count("*").alias("rows"))


def _matches(word: Column, terms: list[str], i: int) -> Column:
    first, last = i == 0, i == len(terms) - 1
    if first and last:
        return F.contains(word, F.lit(terms[i]))
    return F.endswith(word, F.lit(terms[i])) if first else F.startswith(word, F.lit(terms[i])) if last else word == terms[i]


def find(index: DataFrame, known: DataFrame, needle: str, keys: list[str], fields: list[str] | None = None, whole_words: bool = False) -> DataFrame:
    """The distinct (keys, field) whose text holds the needle, whatever its case; with `whole_words` no part of a word counts.
    `known` is the index's dictionary. A needle without words is nowhere."""
    terms = needle.lower().split()
    rows = index.where(F.col("field").isin(*fields)) if fields else index
    if not terms:
        return rows.select(*keys, "field").where(F.lit(False))
    if whole_words:
        wanted = functools.reduce(DataFrame.unionByName, [rows.where((F.col("word") == t) & (F.col("slot") == slot_of(F.lit(t)))).withColumn("i", F.lit(i)) for i, t in enumerate(terms)])
    else:
        words = functools.reduce(DataFrame.unionByName, [known.where(_matches(F.col("word"), terms, i)).select("slot", "word", F.lit(i).alias("i")) for i in range(len(terms))])
        wanted = rows.join(words, ["slot", "word"])
    if len(terms) == 1:
        return wanted.select(*keys, "field").distinct()
    placed = wanted.select(*keys, "field", "i", F.explode("positions").alias("p")).select(*keys, "field", "i", (F.col("p") - F.col("i")).alias("start"))
    whole = placed.groupBy(*keys, "field", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(terms))
    return whole.select(*keys, "field").distinct()


def first_found(index: DataFrame, known: DataFrame, needle: str, key: str, field: str = "all", limit: int = 25) -> DataFrame:
    """key and `whole` of the first rows, by key, whose field (or any, for `all`) holds the needle as whole words; where none does, of those that hold it as a part of
    words. At most `limit` keys, which the driver gets. A field that the index doesn't have is in no row."""
    fields = None if field == "all" else [field]
    for whole in (True, False):
        hits = find(index, known, needle, [key], fields, whole).select(key).distinct().orderBy(key).limit(limit).collect()
        if hits:
            break
    return index.sparkSession.createDataFrame([(r[0], whole) for r in hits], f"`{key}` {dict(index.dtypes)[key]}, whole boolean")
