"""Streams with state against batch folds, also over a restart and with late events; training and selection against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallweave.operators import records, reranker, selection
from recallweave.streaming import stateful, streams
from recallweave.streaming.bursts import BurstStream

EVENTS = "event_id long, user string, ts timestamp, value double, text string"


def events(n, seed=3, start=0):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    return [(start + i, rng.choice(["a", "a", "a", "b", None]), t0 + dt.timedelta(minutes=start + i), rng.choice([1.0, 1.1, 5.0, None]), rng.choice([" x ", "x", "y", "", None])) for i in range(n)]


def two_runs(spark, tmp_path, make, rows, more):
    """What a stream gives over two starts from one checkpoint."""
    source, at, out = (f"{tmp_path}/{n}" for n in ("in", "at", "out"))
    for part in (rows, more):
        spark.createDataFrame(part, EVENTS).repartition(3).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(EVENTS).parquet(source))
        streams.import_available(stream, at, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.parquet(out).drop("batch").collect()


def test_prediction_over_a_restart(spark, tmp_path):
    rows, more = events(80), events(60, 4, 80)
    got = two_runs(spark, tmp_path, lambda s: stateful.residual_gate(s, "user", ["ts", "event_id"], "value", 0.2, 0.3), rows, more)
    want, e = [], {}
    for i, user, _, x, _ in rows + more:
        if x is not None:
            before = e.get(user, 0.0)
            if abs(x - before) > 0.2 * max(abs(before), 1e-9):
                want.append((i, round(abs(x - before), 9)))
            e[user] = before + 0.3 * (x - before)
    assert sorted((r.event_id, round(r.residual, 9)) for r in got) == sorted(want)


def test_copied_over_a_restart(spark, tmp_path):
    rows, more = events(80), events(60, 4, 80)
    got = two_runs(spark, tmp_path, lambda s: stateful.copied(s, "user", ["ts", "event_id"], "text"), rows, more)
    want, last = [], {}
    for i, user, _, _, text in rows + more:
        text = (text or "").strip()
        if text and last.get(user) != text:
            want.append((i, text))
            last[user] = text
    assert sorted((r.event_id, r.text) for r in got) == sorted(want)


def test_days_expire_by_the_watermark(spark, tmp_path):
    day = dt.timedelta(days=1)
    t0 = dt.datetime(2024, 1, 1, 12)
    rows = [(i, "a", t0 + day * (i % 3), 1.0, "") for i in range(9)] + [(90, "b", t0, 1.0, "")]
    more = [(99, "a", t0 + day * 9, 1.0, "")]  # a week after the first two days ended
    late = [(100, "a", t0, 1.0, ""), (101, "a", t0 + day * 20, 1.0, "")]  # the first comes too late to count
    source, at, out, got = *(f"{tmp_path}/{n}" for n in ("in", "at", "out")), []
    for part in (rows, more, late):
        spark.createDataFrame(part, EVENTS).write.mode("append").parquet(source)
        stream = stateful.expired_days(spark.readStream.schema(EVENTS).parquet(source), "user", "ts", 7)
        streams.import_available(stream, at, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        got.append(sorted((r.user, r.day - 19723, r.n) for r in spark.read.parquet(out).collect()))
    assert got[0] == [] and got[1] == [("a", 0, 3), ("a", 1, 3), ("b", 0, 1)]
    assert got[2] == [("a", 0, 3), ("a", 1, 3), ("a", 2, 3), ("a", 9, 1), ("b", 0, 1)]


def test_days_are_counted_without_a_call_for_each(spark, tmp_path):
    """Each day of each key was a value and a timer that Python set one at a time; now they are windows, and an event of a day that hasn't left counts."""
    day, t0 = dt.timedelta(days=1), dt.datetime(2024, 1, 1, 12)
    rows = [(1, "a", t0, 1.0, ""), (2, None, t0, 1.0, ""), (3, "a", None, 1.0, ""), (4, "a", t0 + day * 5, 1.0, "")]
    more = [(5, "a", t0 + day, 1.0, ""), (6, "a", t0 + day * 10, 1.0, "")]
    make = lambda s: stateful.expired_days(s, "user", "ts", 7)
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/one")
    assert "TransformWithState" not in make(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/one"))._jdf.queryExecution().analyzed().toString()
    got = two_runs(spark, tmp_path, make, rows, more)
    assert sorted((r.user or "", r.day - 19723, r.n) for r in got) == [("", 0, 1), ("a", 0, 1), ("a", 1, 1)]


def plain_step(net, rows, rate):
    """One step by finite differences over every weight, pair by pair."""
    def loss(values):
        n = net.with_flat(values)
        return sum(max(0.0, float(reranker.MARGIN - n.output(q[None], q[None], fs[None])[0] + n.output(q[None], v[None], fo[None])[0])) for q, v, fs, fo in rows) / len(rows)
    w, g = net.flat(), np.zeros(len(net.flat()))
    for i in range(len(w)):
        up, down = w.copy(), w.copy()
        up[i], down[i] = w[i] + 1e-6, w[i] - 1e-6
        g[i] = (loss(up) - loss(down)) / 2e-6
    return w - rate * g, loss(w)


def test_training_step_equals_a_plain_loop(spark, tmp_path):
    rng = np.random.default_rng(5)
    memories = spark.createDataFrame([(f"m{i}", rng.normal(size=3).tolist(), ["Semantic", "Goal"][i % 2], i, 1000 * i) for i in range(12)], "id string, vector array<double>, memory_type string, access_count long, timestamp long")
    log = spark.createDataFrame([([f"m{j}" for j in rng.permutation(12)[:5]] + ["gone"], f"m{i}") for i in range(12)] + [(["m1"], None), (["m1", "m2"], "gone"), ([], "m3")], "result_ids array<string>, selected_id string")
    pairs = reranker.pairs(log, memories, 20_000, "semantic")
    assert all(r.selected != r.other and "gone" not in (r.selected, r.other) and r.f_selected[0] == 1.0 and r.f_other[0] == 0.5 for r in pairs.collect())
    rows = [tuple(np.array(r[c]) for c in ("q", "v", "f_selected", "f_other")) for r in pairs.collect()]
    net = reranker.Network.initial(3, 5)
    want, before = plain_step(net, rows, 0.1)
    got, loss = reranker.step(pairs.repartition(4), net, 0.1)
    assert np.allclose(got.flat(), want, atol=1e-6) and loss == pytest.approx(before)
    training = reranker.Training(spark, f"{tmp_path}/weights")
    losses = training.run(pairs, 3, 0.3, 5)
    losses += reranker.Training(spark, f"{tmp_path}/weights").run(pairs, 6, 0.3, 5)  # goes on
    assert len(losses) == 6 and training.last() == 6 and losses[-1] < losses[0]
    straight = net
    for _ in range(6):
        straight, _ = reranker.step(pairs, straight, 0.3)
    assert np.allclose(training.weights().flat(), straight.flat(), atol=1e-9)
    assert reranker.Training(spark, f"{tmp_path}/none").run(pairs.limit(0), 2) == []
    hits = reranker.features(memories.withColumn("similarity", F.lit(0.5)), None, 20_000, "semantic")
    ranked = reranker.rerank(hits, spark.createDataFrame([([1.0, 0.0, 0.0],)], "q array<double>"), straight).collect()
    assert len(ranked) == 12 and all(0.35 <= r.score <= 0.65 for r in ranked)


@pytest.mark.parametrize("few", [4096, 5])
def test_selection_by_index(spark, few):
    rng = np.random.default_rng(6)
    groups = {"skew": [*([7.0] * 4000), *rng.normal(5, 1, 300)], "even": rng.normal(size=2000).tolist(), "one": [3.0], "same": [2.0] * 700, None: [1.0, None, 2.0], "none": [None]}
    df = spark.createDataFrame([(g, v if v is None else float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    got = {r.g: tuple(r[1:]) for r in selection.at_index(df, "g", "v", {"low": lambda n: n * 0 + 10, "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1}, few).collect()}
    for g, vs in groups.items():
        s = sorted(v for v in vs if v is not None)
        at = lambda i: float(s[i]) if 0 <= i < len(s) else None
        assert got[g] == (at(10), at(len(s) // 2), at(len(s) - 1)), g


def test_numbers_and_batches_of_large_groups(spark):
    rows = [(["a", "a", "a", None][i % 4], i, f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, v string").repartition(7)
    got = sorted((str(r.g), r.n, r.k) for r in selection.numbered(df, [F.col("k")], ["g"], "n").collect())
    want, seen = [], {}
    for g, k, _ in rows:
        seen[g] = seen.get(g, 0) + 1
        want.append((str(g), seen[g], k))
    assert got == sorted(want)
    batches = {(r.g, r.batch): (r.content, r["items"]) for r in records.batched(df, "k", "v", 20, ["g"], ",").collect()}
    assert len(batches) == 19 + 7 and batches["a", 0][0].startswith("v0,v1,v2,v4") and batches["a", 18][1] == 375 - 18 * 20
    assert records.batched(df.limit(0), "k", "v", 20, ["g"]).count() == 0


def plain_bursts(rows, gap):
    out = []
    for ts, path in sorted(rows, key=lambda r: r[0]):
        if out and ts - out[-1][1] < gap:
            out[-1][1], out[-1][2] = ts, out[-1][2] + 1
            out[-1][3].add(path)
        else:
            out.append([ts, ts, 1, {path}])
    return [(a, z + gap, n, sorted(p)) for a, z, n, p in out]


def test_bursts_in_two_steps_over_restarts(spark, tmp_path):
    rng, t, rows = random.Random(2), dt.datetime(2024, 1, 1), []
    for _ in range(300):
        t += dt.timedelta(seconds=rng.choice([0, 0.5, 1, 2, 4.9, 5, 7, 20]))  # just a gap parts two bursts
        rows.append((t, f"/p/{rng.randint(0, 9)}"))
    late = (rows[10][0], "/late")
    gap, source = dt.timedelta(seconds=5), f"{tmp_path}/in"
    changes = lambda: spark.readStream.schema("ts timestamp, path string").parquet(source)
    batches: list[int] = []
    for part in (rows[:150], [late, (None, "/none"), *rows[150:]]):
        spark.createDataFrame(part, "ts timestamp, path string").repartition(2).write.mode("append").parquet(source)
        stream = BurstStream(spark, f"{tmp_path}/bursts", 5_000_000, "30 seconds", 8, lambda df, n: batches.append(df.count()))
        stream.run(changes())
    open_ = stream.bursts().count()
    stream.close(changes())
    got = sorted((r.start, r.end, r.changes, r.paths) for r in stream.bursts().collect())
    assert got == plain_bursts(rows, gap) and 0 < open_ < len(got) == sum(batches)
    state = spark.read.format("statestore").load(f"{tmp_path}/bursts/points-at")
    assert state.count() == 1  # what the mark opened; all else has left
    stream.close(changes())  # nothing more comes
    assert stream.bursts().count() == len(got)
