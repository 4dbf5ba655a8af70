"""A table store on plain Parquet: an append-only log of versions, latest wins, compaction to a new directory.

A table is `<root>/<name>/`. Each append writes one directory under `log/` aside and renames it into place, so
readers see whole appends only; every row carries a version (its append's number) and a tombstone flag. The current
state is the newest row of each key that is no tombstone. compact() writes that state as a new base directory whose
number names the last append it holds. A failed write leaves only an unnamed directory behind; nothing is ever deleted
because it can't be read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder to a name that isn't taken; if it is, the folder goes and nothing else changes. The rename itself fails on a
    taken name, so of two writers one wins."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = new.getFileSystem(conf)
    fs.mkdirs(new.getParent())
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf)
        context.rename(old, new, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception:
        if not fs.exists(new):
            raise
    fs.delete(old, True)
    return False


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _list(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = path.getFileSystem(self._conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _place(self, df: DataFrame, folder: str, name: str) -> None:
        aside = f"{self.root}/_aside/{uuid.uuid4().hex}"
        df.write.parquet(aside)
        if not rename_new(self.spark, aside, f"{folder}/{name}"):
            raise RuntimeError(f"version {name} of {folder} was written by another writer; retry")

    def _versions(self, table: str) -> tuple[int, list[int]]:
        bases = [int(x) for x in self._list(f"{self.root}/{table}/base")]
        base = max(bases, default=0)
        return base, [v for v in map(int, self._list(f"{self.root}/{table}/log")) if v > base]

    def exists(self, table: str) -> bool:
        base, log = self._versions(table)
        return bool(base or log)

    def _append(self, table: str, rows: DataFrame, gone: bool | None) -> int:
        """One version of rows; they bring `_gone` themselves where it is None."""
        base, log = self._versions(table)
        version = max([base, *log]) + 1
        marked = rows if gone is None else rows.withColumn("_gone", F.lit(gone))
        self._place(marked.withColumn("_version", F.lit(version)), f"{self.root}/{table}/log", f"{version:012d}")
        return version

    def upsert(self, table: str, rows: DataFrame) -> int:
        return self._append(table, rows, False)

    def insert_new(self, table: str, key: list[str], rows: DataFrame) -> int:
        """Rows whose key is there already are ignored; of rows that share a key one is inserted (see `latest`)."""
        return self.upsert(table, rows.join(self.read(table, key).select(*key), key, "left_anti").select(*rows.columns) if self.exists(table) else rows)

    def delete(self, table: str, keys: DataFrame) -> int:
        return self._append(table, keys, True)

    def delete_where(self, table: str, key: list[str], condition) -> int:
        """All rows that a condition holds for, such as those of one source."""
        return self.delete(table, self.read(table, key).where(condition).select(*key))

    def read(self, table: str, key: list[str]) -> DataFrame:
        base, log = self._versions(table)
        paths = ([f"{self.root}/{table}/base/{base:012d}"] if base else []) + [f"{self.root}/{table}/log/{v:012d}" for v in log]
        rows = None
        for p in paths:
            part = self.spark.read.parquet(p)
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        if rows is None:
            raise FileNotFoundError(f"{self.root}/{table}")
        return latest(rows, key)

    def version(self, table: str, version: int) -> DataFrame:
        """The rows that one version brought, before it is compacted."""
        rows = self.spark.read.parquet(f"{self.root}/{table}/log/{version:012d}")
        return rows.where(~F.col("_gone")).drop("_version", "_gone")

    def replace_where(self, table: str, key: list[str], group: str, rows: DataFrame) -> int:
        """All rows of the groups that `rows` holds are replaced by them, as when a file is indexed again; in one version."""
        if not self.exists(table):
            return self.upsert(table, rows)
        old = self.read(table, key).join(rows.select(group).distinct(), group, "left_semi").join(rows.select(*key), key, "left_anti")
        return self._append(table, rows.withColumn("_gone", F.lit(False)).unionByName(old.withColumn("_gone", F.lit(True)), allowMissingColumns=True), None)

    def compact(self, table: str, key: list[str]) -> None:
        base, log = self._versions(table)
        if log:
            state = self.read(table, key).withColumns({"_version": F.lit(max(log)), "_gone": F.lit(False)})
            self._place(state, f"{self.root}/{table}/base", f"{max(log):012d}")


def latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """The newest version of each key, without tombstones. Of rows of one key in one version the least by a hash of all columns
    counts, so every reader sees the same one. Old versions go before rows meet: each task keeps its newest of a key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_version"), F.xxhash64(*sorted(rows.columns))))
    return rows.withColumn("_r", rank).where((F.col("_r") == 1) & ~F.col("_gone")).drop("_r", "_version", "_gone")
