"""The neighbour graph, the residual index and the word index against exact forms, with growth, odd rows and changes."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallweave.operators import assist, neighbours, search, wordindex
from recallweave.operators.residualindex import Model, ResidualIndex
from recallweave.sources import store


def clustered(n, d=24, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, d))[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.6


def frame(spark, x):
    return spark.createDataFrame([(f"m{i}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")


def exact(x, k):
    y = x / np.linalg.norm(x, axis=1)[:, None]
    s = y @ y.T
    np.fill_diagonal(s, -9)
    return {(f"m{i}", f"m{j}") for i, row in enumerate(np.argsort(-s, axis=1)[:, :k]) for j in row}


def test_descent_finds_nine_in_ten(spark):
    for x in (clustered(1500), np.random.default_rng(2).normal(size=(900, 16))):
        got = {(r.src, r.dst): r.similarity for r in neighbours.descent(frame(spark, x), 5, -2.0, block=128).collect()}
        assert len(got) == 5 * len(x) and len(exact(x, 5) & set(got)) >= 0.9 * 5 * len(x)
        (src, dst), s = next(iter(got.items()))
        a, b = x[int(src[1:])], x[int(dst[1:])]
        assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_descent_compares_less_than_all_pairs():
    """Pairs that a round compares grow with the rows: the first lists are runs of `block`, and a list has at most twice its width."""
    import pyarrow as pa

    for n in (1000, 4000):
        x = clustered(n)
        x /= np.linalg.norm(x, axis=1)[:, None]
        batch = pa.RecordBatch.from_arrays([pa.array([f"m{i}" for i in range(n)]), pa.array(x.tolist())], names=["id", "v"])
        runs = list(neighbours._in_runs(10, 100)(iter([batch.slice(0, 333), batch.slice(333)])))
        assert len(runs) == n // 100 and sum(r.num_rows for r in runs) == 10 * n  # n * 100 comparisons, not n * n


def test_descent_odd_rows(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [-1.0, 0.0]), ("d", None), (None, [1.0, 0.0]), ("e", [0.0, 0.0]), ("f", [None, 1.0]), ("g", [1.0]), ("h", [float("nan"), 1.0]), ("a", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    assert [(r.src, r.dst) for r in neighbours.descent(df, 3, 0.5).orderBy("src").collect()] == [("a", "b"), ("b", "a")]
    assert neighbours.descent(df.limit(0), 3, 0.5).count() == 0 and neighbours.descent(df.limit(1), 3, 0.5).count() == 0
    same = frame(spark, np.ones((300, 4)))
    assert neighbours.descent(same, 3, 0.5, block=50).groupBy("src").count().where("count = 3").count() == 300


def test_pairs_above_passes_over_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("d", None), ("f", [None, 1.0]), ("g", [1.0]), ("h", [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    assert sorted((r.src, r.dst) for r in search.pairs_above(df, 3, 0.5).collect()) == [("a", "b"), ("b", "a")]
    assert search.pairs_above(df.limit(0), 3, 0.5).count() == 0
    assert search.pairs_above(df, 3, 0.5, only=df.select("id")).count() == 2


def test_index_takes_inserts_and_deletes(spark, tmp_path):
    x = clustered(3000, groups=60)
    df = frame(spark, x)
    n = F.substring("id", 2, 9).cast("int")
    index = ResidualIndex.build(df.where(n < 1500), f"{tmp_path}/index", cells=24, parts=8, words=32)
    index.insert(df.where(n >= 1500))
    asked = df.where(n % 30 == 0)
    found = index.search(asked, 10, probes=4)
    got = {(r["query"], r.id) for r in found.collect()}
    want = {(a, b) for a, b in exact(x, 9) if int(a[1:]) % 30 == 0}
    assert len(got) == 1000 and len(want & got) >= 0.9 * len(want)
    assert "PartitionFilters: [cell" in found._jdf.queryExecution().toString() and "cell#" in found._jdf.queryExecution().toString()
    assert all((f"m{i}", f"m{i}") in got for i in range(0, 3000, 30))
    # m30 again with the vector of m60, some rows gone: another handle of the folder sees the same
    index.insert(df.where("id = 'm60'").withColumn("id", F.lit("m30")))
    gone = df.where(n % 4 == 1).select("id")
    index.delete(gone)
    again = ResidualIndex(spark, f"{tmp_path}/index")
    now = again.search(asked.where("id in ('m60', 'm90')"), 10, probes=6).collect()
    assert {r.id for r in now if r["query"] == "m60" and r["rank"] <= 2} == {"m30", "m60"} and len(now) == 20
    assert not any(int(r.id[1:]) % 4 == 1 for r in now)
    assert abs(again.stale_share() - 751 / 3001) < 1e-9 and again.live().count() == 2250
    new = again.rebuilt(f"{tmp_path}/new", cells=24, parts=8, words=32)
    assert new.folder.endswith("new") and new.stale_share() == 0 and new.rows().count() == 2250 and new.rebuilt("unused") is new


def test_index_odd_rows(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", None), (None, [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    index = ResidualIndex.build(df, f"{tmp_path}/odd", cells=4, parts=2, words=4)
    assert sorted(r.id for r in index.live().collect()) == ["a", "d"]
    assert index.search(df.limit(0), 5).count() == 0
    assert [(r["query"], r.id) for r in index.search(df.where("id = 'd'"), 5, probes=4).orderBy("rank").collect()] == [("d", "d"), ("d", "a")]
    with pytest.raises(ValueError):
        ResidualIndex.build(df.limit(0), f"{tmp_path}/none")


def test_codes_are_near_their_rows():
    x = clustered(2000)
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = Model.learn(x, 16, 8, 32, 7)
    cell, code = model.encode(x)
    at = np.flatnonzero(cell == cell[0])
    rough = model.distances(x[:1], int(cell[0]), code[at])[0]
    true = ((x[at] - x[0]) ** 2).sum(1)
    assert np.corrcoef(rough, true)[0, 1] > 0.9


def test_word_index_finds_what_contains_finds(spark, tmp_path):
    rng = random.Random(4)
    words = ["the", "and", "lathe", "android", "Then", "an", "d", "über", "x1"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice([None, "The AND the", ""])) for i in range(300)] + [(300, None, "  the \n and\t")]
    df = spark.createDataFrame(rows, "id long, body string, title string")
    wordindex.postings(df, ["id"], ["body", "title"]).repartition("slot").sortWithinPartitions("word").write.partitionBy("slot").parquet(f"{tmp_path}/p")
    index = spark.read.parquet(f"{tmp_path}/p")
    known = wordindex.dictionary(index)
    joined = [(i, f, " ".join((t or "").lower().split())) for i, b, h in rows for f, t in (("body", b), ("title", h))]
    for needle in ("the and", "he an", "THE", "d", "e and the", "the the", "ber", "x1 über", "none", "n d a"):
        got = {(r.id, r.field) for r in wordindex.find(index, known, needle, ["id"]).collect()}
        assert got == {(i, f) for i, f, t in joined if needle.lower() in t}, needle
        whole = {(r.id, r.field) for r in wordindex.find(index, known, needle, ["id"], whole_words=True).collect()}
        assert whole == {(i, f) for i, f, t in joined if f" {needle.lower()} " in f" {t} "}, needle
    assert wordindex.find(index, known, " ", ["id"]).count() == 0
    title = wordindex.find(index, known, "the and", ["id"], ["title"], whole_words=True)
    plan = title._jdf.queryExecution().toString()
    assert {r.field for r in title.collect()} == {"title"} and "PartitionFilters: [" in plan and "slot#" in plan and "PushedFilters" in plan


def test_new_rows_of_one_id_are_one(spark):
    old = spark.createDataFrame([("a", "text one", [1.0, 0.0], "semantic", 0.5, 0.0, 0, 1)], "id string, content string, vector array<double>, memory_type string, importance double, decay double, access_count long, timestamp long")
    new = spark.createDataFrame([("b", "second", [0.0, 1.0], "semantic", 0.5, 5), ("b", "first", [1.0, 1.0], "semantic", 0.5, 3), ("a", "other", [1.0, 1.0], "semantic", 0.5, 3)], "id string, content string, vector array<double>, memory_type string, importance double, timestamp long")
    assert [(r.id, r.content) for r in assist.fresh(old, new).collect()] == [("b", "first")]
    assert sorted(r.id for r in assist.remember(old, new).memories.collect()) == ["a", "b"]
    goals = spark.createDataFrame([("g", "x", 0.5, 0.0, "Pending")], "id string, description string, priority double, progress double, status string")
    more = spark.createDataFrame([("h", "b", 2.0), ("h", "a", 0.1), ("g", "z", 0.2)], "id string, description string, priority double")
    assert [(r.id, r.description) for r in assist.added_goals(goals, more).orderBy("id").collect()] == [("g", "x"), ("h", "a")]


def test_equal_keys_in_one_version_read_alike(spark, tmp_path):
    tables = store.TableStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("k", i) for i in range(20)], "id string, v int")
    tables.upsert("t", rows)
    seen = {tables.read("t", ["id"]).first().v, tables.read("t", ["id"]).first().v}
    tables.upsert("u", rows.repartition(7).orderBy(F.desc("v")))
    assert len(seen) == 1 and tables.read("u", ["id"]).first().v in seen


def test_no_source_gives_no_rows(spark):
    def broken():
        return spark.read.parquet(f"/nowhere/{uuid.uuid4().hex}")

    assert search.fan_out({"s": (broken, ["id"], "t")}, "x", 3).count() == 0 and search.fan_out({}, "x", 3).columns == ["source", "id"]
