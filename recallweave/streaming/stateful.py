"""Streams whose state has a life of its own: running predictions, the last copied text, and counts by day that expire.

The first two are processors for `transformWithState`: values by key in the state store (RocksDB). Counts by day are windows that the watermark closes.
Rows of a batch come to a key in any order, so a step sorts those of one key by time and id first; bound a batch by
`maxFilesPerTrigger` where a key can be hot. A query that starts again from its checkpoint goes on with the state it had.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """The store that these processors need; a query takes the setting when it starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _sorted(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable").reset_index(drop=True)


class Predicting(StatefulProcessor):
    """State: the prediction. A value that is further from it than a share of it passes; each value moves it by `rate`."""

    def __init__(self, key: str, order: list[str], value: str, threshold: float, rate: float):
        self.key, self.order, self.value, self.threshold, self.rate = key, order, value, threshold, rate

    def init(self, handle) -> None:
        self.expected = handle.getValueState("expected", "e double")

    def handleInputRows(self, key, rows, timerValues):
        e = self.expected.get()[0] if self.expected.exists() else 0.0
        batch, residuals = _sorted(rows, self.order), []
        for x in batch[self.value]:
            if pd.isna(x):
                residuals.append(None)
                continue
            r = abs(x - e)
            residuals.append(r if r > self.threshold * max(abs(e), 1e-9) else None)
            e += self.rate * (x - e)
        self.expected.update((float(e),))
        batch["residual"] = pd.Series(residuals, dtype="float64")
        yield batch.loc[batch["residual"].notna(), [self.key, *self.order, "residual"]]

    def close(self) -> None:
        pass


class Changing(StatefulProcessor):
    """State: the last text. Texts are trimmed; empty ones and repeats of the last don't pass."""

    def __init__(self, key: str, order: list[str], text: str):
        self.key, self.order, self.text = key, order, text

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "text string")

    def handleInputRows(self, key, rows, timerValues):
        batch = _sorted(rows, self.order)
        batch[self.text] = batch[self.text].str.strip()
        batch = batch[batch[self.text].notna() & (batch[self.text] != "")]
        if len(batch):
            before = batch[self.text].shift()
            before.iloc[0] = self.last.get()[0] if self.last.exists() else None
            self.last.update((batch[self.text].iloc[-1],))
            yield batch.loc[batch[self.text] != before, [self.key, *self.order, self.text]]

    def close(self) -> None:
        pass


def _schema(events: DataFrame, names: list[str], more: str = "") -> str:
    types = dict(events.dtypes)
    return ", ".join([f"`{n}` {types[n]}" for n in names] + ([more] if more else []))


def residual_gate(events: DataFrame, key: str, order: list[str], value: str, threshold: float = 0.1, rate: float = 0.1) -> DataFrame:
    """key, order, residual of the events whose value is further than `threshold` times the running prediction from it. Null values don't count."""
    keep_state_in_rocksdb(events.sparkSession)
    rows = events.select(key, *order, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).transformWithStateInPandas(Predicting(key, order, value, threshold, rate), _schema(events, [key, *order], "residual double"), "Append", "None")


def copied(events: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """key, order, text of each copied text that isn't the one before it of the same key."""
    keep_state_in_rocksdb(events.sparkSession)
    return events.select(key, *order, text).groupBy(key).transformWithStateInPandas(Changing(key, order, text), _schema(events, [key, *order, text]), "Append", "None")


def expired_days(events: DataFrame, key: str, ts: str = "ts", days: int = 7, delay: str = "1 minute") -> DataFrame:
    """key, day, n: what leaves the store `days` after a day's end, by a watermark that comes so much later. What hasn't left is what is retained; an event
    that comes late counts as long as its day hasn't left. Counts are partial sums of the tasks before they are shuffled, and one state a key and day."""
    keep_state_in_rocksdb(events.sparkSession)
    rows = events.select(key, ts).withWatermark(ts, f"{days} days {delay}")
    counts = rows.groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n"))
    return counts.select(key, (F.unix_millis("w.start") / DAY_MS).cast("bigint").alias("day"), "n")
