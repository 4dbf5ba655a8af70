"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of slots holds a bit for every language in each slot. The slots of an n-gram, ANDed, give the
bitmask of all languages whose filter holds it, so one probe asks every language at once. A document's
bits are counted per language, each count is corrected for the false positives that the fill of that
language's slice lets through, and divided by the share that the language's own text reaches; the largest
of these decides.

Edge cases: a null text, or one without a letter, is `und` with score 0. A text of which no n-gram is
known gets the most frequent learned language with score 0. Without any learned language every
text is `und`. Ties go to the language that sorts first.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_batches, forget, settle, unit_hash
from .textkit import U64, blocks, code_points, constants, mix

UNDETERMINED = "und"
ORDERS = (1, 2, 3, 4)
#: N-grams of this order or more tell a language from other text in its letters; shorter ones nearly all texts share.
TELLING = 3
#: Code points from here on are in planes without assigned letters.
_PLANES = 0x40000


@functools.cache
def _alphabet() -> np.ndarray:
    """Lower-cased code point of each letter, and a space for all else."""
    out = np.full(_PLANES, 0x20, np.uint32)
    for i in range(_PLANES):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_PLACE = constants(max(ORDERS), 31)
_PROBE = constants(3, 37)


def _ngrams(raw: np.ndarray, at: np.ndarray):
    """For each order: (hashes, document index). Runs of anything but letters count as one space."""
    points, offsets = code_points(raw, at)
    norm = _alphabet()[np.minimum(points, _PLANES - 1)]
    letter = norm != 0x20
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    keep[first] = letter[first]  # what stands before a text is no part of it
    doc = np.repeat(np.arange(len(at) - 1), np.diff(offsets))
    norm, letter, doc = norm[keep], letter[keep], doc[keep]
    symbol = mix(norm.astype(U64))
    rolled = np.zeros(len(symbol), U64)
    for n in ORDERS:
        m = len(symbol) - n + 1
        if m <= 0:
            yield n, np.zeros(0, U64), np.zeros(0, np.int64)
            continue
        rolled = rolled[:m] + symbol[n - 1 :] * _PLACE[n - 1]
        good = doc[:m] == doc[n - 1 :]
        if n == 1:
            good = good & letter
        yield n, mix(rolled[good] + U64(n)), doc[:m][good]


def _slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((grams * p) >> U64(64 - bits)).astype(np.int64) for p in _PROBE]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    most_frequent: int
    table: np.ndarray  # (slots, bytes of languages)
    false_positive: np.ndarray
    reach: np.ndarray
    telling_reach: np.ndarray
    bits: int

    def score(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of n-grams by document and language: corrected, relative to own text; n-grams)."""
        return self.scores(raw, at)[:2]

    def scores(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As score, of all n-grams and then of those of order TELLING or more."""
        n, wide = len(at) - 1, self.table.shape[1]
        hits, total = np.zeros((2, n, wide * 8)), np.zeros((2, n))
        for order, grams, doc in _ngrams(raw, at):
            part = int(order >= TELLING)
            total[part] += np.bincount(doc, minlength=n)
            a, b, c = _slots(grams, self.bits)
            for w in range(wide):
                column = self.table[:, w]
                mask = column[a] & column[b] & column[c]
                seen = np.bincount(doc * 256 + mask, minlength=n * 256).reshape(n, 256)
                hits[part, :, w * 8 : w * 8 + 8] += seen @ _BITS
        return *self._relative(hits.sum(0), total.sum(0), self.reach), *self._relative(hits[1], total[1], self.telling_reach)

    def _relative(self, hits: np.ndarray, total: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        expected = self.false_positive * total[:, None]
        corrected = np.maximum(hits[:, : len(self.languages)] - expected, 0) / (1 - self.false_positive)
        return corrected / np.maximum(total, 1)[:, None] / reach, total


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    per_language: int = 1500,
    least_share: float = 2e-5,
    contrast: float = 0.4,
    bits: int = 20,
) -> LanguageModel:
    """Learn the filters from rows with a language. At most about `per_language` rows of each language are
    read (a bounded sample by a hash of the key; the bound is on its expectation). An n-gram enters a
    language's filter if it makes up at least `least_share` of that language's n-grams of its order and
    at least `contrast` of the largest such share in any language; so a filter holds at most
    len(ORDERS) / least_share n-grams, which bounds what the driver gathers."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not sizes:
        return LanguageModel((), 0, np.zeros((1, 1), np.uint8), np.zeros(0), np.ones(0), np.ones(0), 0)
    languages = tuple(sorted(sizes))
    share = F.coalesce(*[F.when(F.col(lang) == k, F.lit(min(1.0, per_language / n))) for k, n in sizes.items()])
    sample = rows.where(unit_hash(F.col(key), F.lit(101)) < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        found: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, raw, at in blocks(batch.column(1)):
                own = np.array([languages.index(x) for x in names[i:j]])
                for n, grams, doc in _ngrams(raw, at):
                    for k in np.unique(own[doc]) if len(doc) else ():
                        found.setdefault((languages[k], n), []).append(np.unique(grams[own[doc] == k], return_counts=True))
        for (name, n), parts in found.items():
            grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(grams)), pa.array(np.full(len(grams), n, np.int32)), pa.array(grams.view(np.int64)), pa.array(counts)],
                names=["lang", "n", "gram", "c"],
            )

    counted = settle(sample.mapInArrow(count, "lang string, n int, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")), "ngrams", sum(min(n, per_language) for n in sizes.values()), 1000)
    totals = {(r[0], r[1]): r[2] for r in counted.groupBy("lang", "n").agg(F.sum("c")).collect()}
    least = F.coalesce(*[F.when((F.col("lang") == k) & (F.col("n") == n), F.lit(least_share * t)) for (k, n), t in totals.items()], F.lit(0.0))
    often = counted.where(F.col("c") >= least).toPandas()
    forget(counted)

    gram = often["gram"].to_numpy(np.int64).view(U64)
    own = np.searchsorted(languages, often["lang"].to_numpy(str))
    rate = often["c"].to_numpy(float) / np.array([totals[x] for x in zip(often["lang"], often["n"], strict=True)], float)
    distinct, at = np.unique(gram, return_inverse=True)
    top = np.zeros(len(distinct))
    np.maximum.at(top, at, rate)
    member = rate >= contrast * top[at]
    slices = np.zeros((1 << bits, (len(languages) + 7) // 8), np.uint8)
    for k in range(len(languages)):
        for slot in _slots(gram[member & (own == k)], bits):
            slices[slot, k // 8] |= 1 << (k % 8)
    filled = np.array([((slices[:, k // 8] >> (k % 8)) & 1).mean() for k in range(len(languages))])
    order, c = often["n"].to_numpy(), often["c"].to_numpy()
    reach, telling = (
        np.maximum([sum(c[member & (own == k) & (order >= least)]) / max(1, sum(t for (x, n), t in totals.items() if x == name and n >= least)) for k, name in enumerate(languages)], 1e-9)
        for least in (1, TELLING)
    )
    return LanguageModel(languages, languages.index(max(sorted(sizes), key=sizes.get)), slices, filled ** len(_PROBE), reach, telling, bits)


def predict(model: LanguageModel, text: Column) -> Column:
    """A struct of lang string, score double, coverage double (the winner's share of n-grams relative to
    that language's own text, at most 1) and claim double for each whole text. The score is the winner's part
    of the sum of the two best shares. The claim is the largest share that any language has of the n-grams of
    order TELLING or more, relative to its own text, plus 1 / sqrt(their number), which leaves room for
    the chance in short texts; at most 1, and 1 for a text with a letter but without such n-grams."""
    sent = None

    @arrow_udf("struct<lang:string,score:double,coverage:double,claim:double>")
    def identify(texts: pa.Array) -> pa.Array:
        m = sent.value
        n = len(texts)
        best, score, coverage, claim = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n)
        for i, j, raw, at in blocks(texts) if m.languages else ():
            shares, total, telling, count = m.scores(raw, at)
            first = np.argmax(shares, axis=1)
            top = shares[np.arange(j - i), first]
            rest = np.partition(shares, -2, axis=1)[:, -2] if shares.shape[1] > 1 else np.zeros(j - i)
            known = top > 0
            has_letter = total > 0
            best[i:j] = np.where(has_letter, np.where(known, first, m.most_frequent), -1)
            score[i:j] = np.where(known, top / np.maximum(top + rest, 1e-300), 0.0)
            coverage[i:j] = np.minimum(top, 1.0)
            claim[i:j] = np.where(has_letter, np.minimum(telling.max(axis=1) + 1 / np.sqrt(np.maximum(count, 1)), 1.0), 0.0)
        names = np.array([*m.languages, UNDETERMINED], object)[best]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(coverage), pa.array(claim)], names=["lang", "score", "coverage", "claim"])

    spark = SparkSession.active()
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # at most 2**bits * languages / 8 bytes
    return identify(text)


def in_a_language(docs: DataFrame, text: str = "text", lang: str = "lang", least_claim: float = 0.32, **how) -> DataFrame:
    """docs without the rows that no learned language claims: texts without a letter, and texts whose claim
    (see predict) is under `least_claim`. On the test tables random letters and base64 reach 0.11, hex
    digits and six unlearned languages in Latin letters 0.28, and the lowest clean document 0.36. Close relatives of the
    learned languages (Dutch, Portuguese) lie above that and stay. Where no text with
    letters has a language there is nothing to compare with, and every text with a letter stays."""
    model = fit(docs, text, lang, **how)
    if not model.table.any():
        return docs.where(F.col(text).rlike(r"\p{L}"))
    found = docs.withColumn("__rw_found", predict(model, F.col(text)))
    return found.where((F.col("__rw_found.lang") != UNDETERMINED) & (F.col("__rw_found.claim") >= least_claim)).select(*docs.columns)
