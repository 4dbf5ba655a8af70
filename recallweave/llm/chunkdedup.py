"""Substring deduplication by content-defined chunking.

A gear hash rolls over the text's bytes. A chunk begins at each word start where the hash of the bytes just
before it is the least among `REACH` word starts on either side, so cuts follow content: an insertion moves the chunks after it but doesn't
change them, and a passage that stands in two documents has the same chunks inside in both. Single chunks
are short (three words on average) and common ones stand in very many documents, so what is looked up by its digest is a chunk with as
many of its followers as hold `min_words` words: no shorter run is ever reported, and since a passage may lose what it has of
the chunks at its ends, passages are found surely from half as many words more (with 20: 0.8 of those of 25 words, 0.98 of 28, all of 30). A stretch of which an equal one stands in a document with a smaller
id, or earlier in the same document, is repeated; overlapping and adjoining repeated stretches are one repeated
passage. So no passage is put together from phrases of different origin, whatever the size of the corpus. Digests have 128 bits.

Edge cases: null and empty texts have no chunks, and texts of fewer than `min_words` words no stretches; a null text stays null. Rows with the same id and text are
one document: both are treated alike. Different texts under one id, or under none, are documents of their own: they come in the
order of a hash, those without an id after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTES_A_FILE, bounded_batches, in_files, maybe_in, settle
from .textkit import BLOCK_BYTES, WINDOW, blocks, constants, span_hash, words

_GEAR = (constants(256, 53) >> np.uint64(32)).astype(np.uint32)
#: Bytes that a gear hash covers.
_ROLL = 8
#: Word starts on either side among which a cut has the least hash.
REACH = 1
_NEVER = np.uint32(0xFFFFFFFF)
MIN_WORDS = 20


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + g(byte) of the last _ROLL bytes at each place, by doubling."""
    h = _GEAR[raw]
    width = 1
    while width < _ROLL:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def _gear_before(raw: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The gear hash just before each word start; a window of the text at a time."""
    out = np.full(len(word), _NEVER)
    for a in range(0, len(raw), WINDOW):
        low, b = max(0, a - _ROLL), min(a + WINDOW, len(raw))
        i, j = np.searchsorted(word, [a, b], "right")
        out[i:j] = gear(raw[low:b])[word[i:j] - 1 - low]
    return out


def chunk_starts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start byte of each chunk, words in it); every text with bytes has a chunk at its start. Equal least hashes all
    cut, so texts that say few words over and over are cut at least once a period. Places without _ROLL bytes of their text before them don't cut."""
    word, _, doc = words(raw, at)
    cut = word - at[doc] >= _ROLL
    h = np.where(cut, _gear_before(raw, word), _NEVER)
    for d in range(1, REACH + 1):
        apart = doc[d:] != doc[:-d]
        cut[d:] &= (h[d:] <= h[:-d]) | apart
        cut[:-d] &= (h[:-d] <= h[d:]) | apart
    starts = np.unique(np.concatenate([word[cut], at[:-1][np.diff(at) > 0]]))
    count = np.diff(np.searchsorted(word, np.append(starts, len(raw))))
    return starts, count


def _stretches(raw: np.ndarray, at: np.ndarray, min_words: int, whole: bool):
    """For each chunk that has enough words with its followers: document index, a digest, and with `whole` a second one, place (start in code
    points, words before it) and size (code points, words, and whether an equal stretch stands earlier in the document)."""
    starts, count = chunk_starts(raw, at)
    doc = np.searchsorted(at, starts, "right") - 1
    before = np.concatenate([[0], np.cumsum(count)])
    # The last chunk of each stretch: the first with which it holds enough words.
    last = np.searchsorted(before, before[:-1] + max(1, min_words)) - 1
    full = last < len(starts)
    full[full] = doc[last[full]] == doc[full]
    first_word = before[np.searchsorted(doc, doc)]
    ends = np.append(starts[1:], len(raw))[last[full]]
    n_words, word = before[last[full] + 1] - before[:-1][full], (before[:-1] - first_word)[full]
    starts, doc = starts[full], doc[full]
    digests = [span_hash(raw, starts, ends, way).view(np.int64) for way in ((0, 1) if whole else (0,))]
    if not whole:
        return doc, *digests
    lead = np.zeros(len(raw) + 1, np.int32)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    order = np.lexsort((starts, *digests, doc))
    again = np.zeros(len(starts), bool)
    again[order[1:]] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (*digests, doc)])
    place = ((lead[starts] - lead[at[doc]]).astype(np.int64) << 32) | word
    size = ((lead[ends] - lead[starts]).astype(np.int64) << 32) | (n_words << 1) | again
    return doc, *digests, place, size


def _emit(min_words: int, whole: bool):
    names = ["digest", *(["second", "place", "size"] if whole else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.drop_columns(["text"])
            for i, j, raw, at in blocks(batch.column("text"), BLOCK_BYTES // 2):
                if len(raw):
                    doc, *found = _stretches(raw, at, min_words, whole)
                    yield pa.RecordBatch.from_arrays([*own.slice(i, j - i).take(pa.array(doc)).columns, *map(pa.array, found)], names=[*own.schema.names, *names])

    return run


def identity(key: str, text: str) -> dict[str, Column]:
    """Two numbers that tell documents apart: the id, or without one a hash of the text; and a hash of id and text."""
    own = F.col(key).cast("long")
    return {"own": F.coalesce(own, F.xxhash64(F.col(text), F.lit(1))), "node": F.xxhash64(own, F.col(text))}


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of overlapping or adjoining stretches, from sorted stretches; the last run waits, as one row, for what may adjoin it in the next batch.
    Later stretches of a text never end before earlier ones."""
    held = None
    for batch in batches:
        own, node, none, place, size = (np.asarray(batch.column(k)) for k in range(5))
        first = batch.column(5).fill_null(0)
        start, chars, word = place >> 32, size >> 32, place & 0xFFFFFFFF
        rows = [own, node, none, start, start + chars, word, word + ((size & 0xFFFFFFFF) >> 1), np.ones(len(own), np.int64), np.asarray(first), np.asarray(batch.column(5).is_valid())]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        new = np.ones(len(rows[0]), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1]) | (rows[3][1:] > rows[4][:-1])
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(new)) - 1
        known = np.maximum.reduceat(rows[9], at)
        least = np.minimum.reduceat(np.where(rows[9], rows[8], (1 << 63) - 1), at)
        runs = [rows[0][at], rows[1][at], rows[2][at], rows[3][at], rows[4][end], rows[5][at], rows[6][end], np.add.reduceat(rows[7], at), np.where(known, least, 0), known]
        held = [r[-1:] for r in runs]
        if len(at) > 1:
            yield _report([r[:-1] for r in runs])
    if held is not None:
        yield _report(held)


PASSAGE = "id long, own long, node long, start long, chars long, words long, stretches long, first_id long"


def _report(runs) -> pa.RecordBatch:
    own, node, none, start, end, word, end_word, n, first, known = runs
    columns = [pa.array(own, mask=none.astype(bool)), pa.array(own), pa.array(node), pa.array(start), pa.array(end - start), pa.array(end_word - word), pa.array(n), pa.array(first, mask=~known.astype(bool))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PASSAGE.split(", ")])


#: A chunk has about three words.
BYTES_A_CHUNK = 16


def _bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, start and chars (code points), words, repeated stretches in it of every repeated passage, and the
    smallest id of a document with one of these; own and node tell its document (see identity).

    First the digests alone are counted, which a partial aggregate reduces before they meet. Of the full stretches only those go on that a
    Bloom filter of the digests that come more than once lets pass; they are written, and what follows reads that table. A
    stretch that very many documents share reaches one task as one row from each; the join of written tables is one that
    adaptive execution can split."""
    bounded_batches(docs.sparkSession)
    n = _bytes(docs, text) // BYTES_A_CHUNK
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), *[c.alias(n) for n, c in identity(key, text).items()], F.col(text).alias("text"))
    digest, by = ["digest", "second"], "digest long, second long"
    more = rows.select("text").mapInArrow(_emit(min_words, False), "digest long").groupBy("digest").count().where("count > 1")
    more = settle(more.select("digest"), "digests", n)
    full = rows.mapInArrow(_emit(min_words, True), f"id long, own long, node long, {by}, place long, size long")
    full = settle(maybe_in(full, "digest", more), "candidates")
    several = full.groupBy(*digest).agg(F.min("node").alias("a"), F.max("node").alias("b"), F.min("id").alias("first")).where("a < b")
    shared = settle(several.select(*digest, "first"), "shared", n)
    met = full.join(shared.withColumn("met", F.lit(True)), digest, "left").withColumn("met", F.coalesce("met", F.lit(False)))
    later = (F.col("size").bitwiseAND(F.lit(1)) == 1) | (F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first"))))
    tied = F.col("met") & F.col("id").eqNullSafe(F.col("first"))
    # Ids (and none) of several texts: there the order within the smallest id matters too.
    odd = rows.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select(F.col("id").alias("odd"))
    if odd.limit(1).count():
        met = settle(met.where(later | tied), "stretches")
        holder = met.where(tied).join(settle(odd, "odd"), F.col("id").eqNullSafe(F.col("odd")), "left_semi").groupBy(*digest).agg(F.min("node").alias("holder"))
        repeated = met.join(settle(holder, "holders"), digest, "left").where(later | (tied & (F.col("node") > F.col("holder"))))
    else:
        repeated = met.where(later)
    # Rows with equal id and text give each stretch as often; one of each is enough.
    once = repeated.groupBy("own", "node", F.col("id").isNull().alias("none"), "place", "size").agg(F.min(F.coalesce("first", "id")).alias("first"))
    return once.repartition("own", "node").sortWithinPartitions("own", "node", "none", "place").mapInArrow(_passages, PASSAGE)


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with every repeated passage cut from its text; rows, order of columns and other values stay."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for whole, found in zip(texts, spans, strict=True):
            if not found.is_valid:
                out.append(None)
                continue
            whole, parts, upto = whole.as_py(), [], 0
            for s in sorted(found.as_py(), key=lambda s: s["start"]):
                parts.append(whole[upto : s["start"]])
                upto = s["start"] + s["chars"]
            out.append("".join([*parts, whole[upto:]]))
        return pa.array(out, pa.string())

    found = repeated_passages(docs, key, text, min_words)
    spans = found.groupBy(F.col("own").alias("__rw_own"), F.col("node").alias("__rw_node")).agg(F.collect_list(F.struct("start", "chars")).alias("__rw_spans"))
    ready = docs.withColumns({f"__rw_{n}": c for n, c in identity(key, text).items()})
    joined = ready.join(spans, ["__rw_own", "__rw_node"], "left")
    touched = F.col("__rw_spans").isNotNull()  # other texts don't go through Python
    joined = in_files(joined, _bytes(docs, text), BYTES_A_FILE)
    return joined.withColumn(text, F.when(touched, cut(F.when(touched, F.col(text)), F.col("__rw_spans"))).otherwise(F.col(text))).select(*docs.columns)
