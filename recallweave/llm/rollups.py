"""Token counts as delta-maintained rollups.

A rollup keeps additive totals by source, language and tokenizer version. It changes only through batches
of signed rows: an insert counts +1, a delete -1, and a revised count is a delete of the old and an insert
of the new. A batch is aggregated, written aside and renamed into place in one step under its id; an id that
is there already, or that a snapshot has absorbed, is not applied again, so a batch can be retried after
any failure. Totals are the newest snapshot and the batches after it. Commits and compactions may run at the same time: each sums the
folders that it listed, and a rename decides which of two writers was first. A reader whose batches a compaction has just
removed fails on a missing file and asks again.

Edge cases: null sources, languages and tokenizers are groups of their own; a null count is 0; groups
whose totals are all zero have no row; an empty batch commits its id.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
TOTALS = ("docs", "tokens", "chars")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"
#: Files of a batch at most: it has a row for each group.
FILES = 16
#: A word is a run of anything but 0x20 and 0x09 to 0x0D; a piece is a run of letters, a digit or a mark.
WORDS = r"[^\x20\x09-\x0D]+"
PIECES = r"\p{L}+|[0-9]|[^\p{L}0-9\x20\x09-\x0D]"
#: Words with a letter or digit.
SOUND_WORDS = r"[^\x20\x09-\x0D]*[\p{L}0-9][^\x20\x09-\x0D]*"


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _fs(self, path: str):
        at = self._hadoop.Path(path)
        return at.getFileSystem(self._conf), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _place(self, aside: str, folder: str, name: str) -> bool:
        """Rename into place; False if another writer was first."""
        fs, parent = self._fs(f"{self.path}/{folder}")
        fs.mkdirs(parent)
        target = self._hadoop.Path(parent, name)
        fs, source = self._fs(aside)
        if not fs.exists(target):
            try:
                context = self._hadoop.FileContext.getFileContext(target.toUri(), self._conf)
                none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(source, target, none)  # fails if the target is there
                return True
            except Exception:
                if not fs.exists(target):
                    raise
        fs.delete(source, True)
        return False

    def batches(self) -> list[str]:
        """Ids of all batches that count, those in the snapshot included."""
        base = self._base()
        absorbed = [r[0] for r in self._applied(base).collect()] if base else []
        return sorted({unquote(n) for n in self._names("batches")} | set(absorbed))

    def _base(self) -> str | None:
        names = self._names("bases")
        return f"{self.path}/bases/{names[-1]}" if names else None

    def _applied(self, base: str) -> DataFrame:
        return self.spark.read.schema("id string").parquet(f"{base}/applied")

    def _pending(self, base: str | None) -> list[str]:
        """Folders of the batches that are not in that snapshot; as many as came since it was made."""
        names = self._names("batches")
        if not base or not names:
            return names
        known = {r[0] for r in self._applied(base).where(F.col("id").isin([unquote(n) for n in names])).collect()}
        return [n for n in names if unquote(n) not in known]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply signed changes (source, lang, tokenizer, sign, tokens, chars) once; False if the id counts already."""
        base = self._base()
        if quote(batch_id, safe="") in self._names("batches") or base and self._applied(base).where(F.col("id") == batch_id).limit(1).count():
            return False
        signed = [F.sum(F.col("sign") * v).cast("long").alias(n) for n, v in (("docs", F.lit(1)), ("tokens", F.coalesce("tokens", F.lit(0))), ("chars", F.coalesce("chars", F.lit(0))))]
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        changes.groupBy(*KEYS).agg(*signed).coalesce(FILES).write.parquet(aside)
        return self._place(aside, "batches", quote(batch_id, safe=""))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, chars as of now: of the newest snapshot and the batches after it."""
        base = self._base()
        return self._sum(base, self._pending(base))

    def _sum(self, base: str | None, names: list[str]) -> DataFrame:
        parts = [self.spark.read.schema(SCHEMA).parquet(x) for x in ([f"{base}/totals"] if base else [])]
        # A quoted id may hold "%": names go to the reader as they are, one by one.
        parts += [self.spark.read.schema(SCHEMA).parquet(f"{self.path}/batches/{n}") for n in names]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.groupBy(*KEYS).agg(*[F.sum(t).cast("long").alias(t) for t in TOTALS]).where("docs <> 0 or tokens <> 0 or chars <> 0")

    def compact(self) -> bool:
        """Fold the batches that are there now into a new snapshot; their folders go afterwards, their ids stay known.
        The list of folders is fixed once, and exactly those are summed and named, so a batch that is committed meanwhile stays
        a batch of its own. False if another compaction was first."""
        bases = self._names("bases")
        base = f"{self.path}/bases/{bases[-1]}" if bases else None
        names = self._pending(base)
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        self._sum(base, names).coalesce(FILES).write.parquet(f"{aside}/totals")
        ids = self.spark.createDataFrame([(unquote(n),) for n in names], "id string")
        (ids.unionByName(self._applied(base)) if base else ids).coalesce(1).write.parquet(f"{aside}/applied")
        if not self._place(aside, "bases", f"{len(bases):09d}"):
            return False
        fs, folder = self._fs(f"{self.path}/batches")
        for name in names:
            fs.delete(self._hadoop.Path(folder, name), True)
        return True


def signed(rows: DataFrame, tokenizer: str, tokens: Column, sign: int) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).alias("sign"), tokens.alias("tokens"), "chars")


def corpus_history(docs: DataFrame, path: str, settle) -> TokenRollup:
    """A corpus's history as four batches: all documents inserted under two tokenizers, later exact copies
    deleted, and the word counts revised to leave out words without a letter or digit. The first
    batch is sent twice."""
    text = F.coalesce("text", F.lit(""))
    rows = settle(
        docs.select(
            F.col("doc_id"), F.md5(text).alias("h"), "source", "lang",
            F.length(text).cast("long").alias("chars"), count_matches(text, WORDS).alias("w"), count_matches(text, PIECES).alias("p"), count_matches(text, SOUND_WORDS).alias("s"),
        ),
        "counts",
    )
    rollup = TokenRollup(docs.sparkSession, path)
    rollup.commit("words", signed(rows, "words-1", F.col("w"), 1))
    rollup.commit("pieces", signed(rows, "pieces-1", F.col("p"), 1))
    first = settle(rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first"), "firsts", rows.count())
    joined = rows.join(first, "h", "left").withColumn("first", F.coalesce("first", "doc_id"))
    copies, kept = joined.where("doc_id > first"), joined.where("not coalesce(doc_id > first, false)")
    rollup.commit("copies", signed(copies, "words-1", F.col("w"), -1).unionByName(signed(copies, "pieces-1", F.col("p"), -1)))
    changed = kept.where("w <> s")
    rollup.commit("revised words", signed(changed, "words-1", F.col("w"), -1).unionByName(signed(changed, "words-1", F.col("s"), 1)))
    rollup.commit("words", signed(rows, "words-1", F.col("w"), 1))
    return rollup
