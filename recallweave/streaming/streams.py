"""Structured Streaming forms of the activity and import streams; see bursts and stateful for the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changed_only(events: DataFrame, key: str, values: list[str], ts: str = "ts") -> DataFrame:
    """Events whose values differ from the one before of the same key, with the last values as state."""
    names = [key, ts, *values]
    types = dict(events.dtypes)
    schema = ", ".join(f"{n} {types[n]}" for n in names)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values([ts, *values]).reset_index(drop=True)
        now = rows[values].astype("string")
        before = now.shift()
        same = ((now == before) | (now.isna() & before.isna())).fillna(False).all(axis=1).to_numpy(bool)
        first, end = (tuple(None if pd.isna(v) else v for v in now.iloc[i]) for i in (0, -1))
        same[0] = first == last  # only the edge needs the state
        state.update(end)
        yield rows.loc[~same, names]

    return events.groupBy(key).applyInPandasWithState(step, schema, ", ".join(f"v{i} string" for i in range(len(values))), "append", GroupStateTimeout.NoTimeout)


def import_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Everything that is new since the last call, in whole batches; the position advances only when the sink
    has succeeded."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now, written as Parquet below a shared folder and read from there. A batch that is tried again replaces
    itself; in complete mode each batch replaces the one before."""
    spark = stream.sparkSession
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n if mode == 'append' else 0}")
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")  # a folder is there, whatever came
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def as_stream(spark, table: DataFrame, path: str) -> DataFrame:
    """A Parquet file or folder as a stream of its files."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(table.schema).option("pathGlobFilter", name).parquet(folder) if not _is_dir(spark, path) else spark.readStream.schema(table.schema).parquet(path)


def _is_dir(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.getFileStatus(p).isDirectory()
