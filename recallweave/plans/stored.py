"""Tables that searches and graph steps read: made once from an input, written to the shared folder, and read from there.

A table's folder is named after the application, the input's folder and the length and time of its files, so another
input, or a changed one, gets tables of its own. It is written aside and renamed into place, so whoever comes second reads the first one's."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import shared_folder
from ..sources.store import rename_new


def _state(spark: SparkSession, sf_dir: str, tables: Iterable[str]) -> str:
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf()
    out = [sf_dir]
    for t in tables:
        at = path(f"{sf_dir}/{t}.parquet")
        out += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in at.getFileSystem(conf).listStatus(at)]
    return hashlib.md5("\n".join(out).encode()).hexdigest()


def stored(spark: SparkSession, sf_dir: str, name: str, sources: Iterable[str], make: Callable[[], DataFrame], by: Iterable[str] = ()) -> DataFrame:
    folder = f"{shared_folder(spark)}/index-{spark.sparkContext.applicationId}"
    final = f"{folder}/{name}-{_state(spark, sf_dir, sources)}"
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(final), spark._jsparkSession.sessionState().newHadoopConf()
    if not path.getFileSystem(conf).exists(path):
        aside = f"{folder}/aside-{uuid.uuid4().hex}"
        make().write.partitionBy(*by).parquet(aside)
        rename_new(spark, aside, final)
    return spark.read.parquet(final)
