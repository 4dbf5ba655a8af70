"""Learners that move, beliefs, introspection, projections, searches in a store that knows no sources."""

import numpy as np
from pyspark.sql import functions as F

from recallweave.operators import browse, learning, learnloop, lifecycle, search, wordindex


def test_projections_are_uniform_and_repeatable():
    p = learning.planes(64, 256, 42)
    assert p.shape == (64, 256) and (p == learning.planes(64, 256, 42)).all() and (p != learning.planes(64, 256, 43)).any()
    assert (p[:32] == learning.planes(64, 256, 42)[:32]).all() and abs(p.mean()) < 0.005 and abs(p.var() * 64 - 1) < 0.05
    assert np.abs(np.corrcoef(p)[np.triu_indices(64, 1)]).max() < 0.35
    mean = np.abs(p.T @ p - np.diag((p**2).sum(0))).mean()
    assert mean < 0.15  # columns are nearly at right angles, as independent ones are


def test_sparse_codes_equal_a_loop(spark):
    x = np.random.default_rng(1).normal(size=(20, 16))
    rows = spark.createDataFrame([(n, [float(c) for c in v]) for n, v in enumerate(x)], "n int, vector array<double>")
    p = learning.planes(16, 64, 42)
    for r in learning.sparse_novelty(rows).collect():
        y = x[r.n] @ p
        top = sorted(sorted(range(64), key=lambda j: (-y[j], j))[:10])
        assert r.code == top and abs(r.novelty - min(1.0, np.maximum(y[top], 0).sum() / 10)) < 1e-9


STORE = "id string, source string, vector array<double>"


def test_a_store_without_sources_is_searched_by_ids(spark):
    files = spark.createDataFrame([("/a::b/c.md", "c.md", "md"), ("/d.rs", "d.rs", "rs")], "path string, name string, ext string")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    ids = ["file::/a::b/c.md::2", "file::/d.rs::0", "file::/gone.md::0", "file::/d.rs::x", "memory::1", "mail://file::/d.rs::0", None]
    for source, most in (("file", 4), (None, 4)):
        rows = spark.createDataFrame([(i, source if i and i.startswith("file") else None, [1.0, 0.1 * n]) for n, i in enumerate(ids)] + [("file::/d.rs::9", source, None)], STORE)
        got = [(r.path, r.chunk_index) for r in search.search_store(rows, files, q, most).collect()]
        assert got == [("/a::b/c.md", 2), ("/d.rs", 0)]
    many = spark.createDataFrame([(f"memory::{n}", None, [1.0, 0.0]) for n in range(30)] + [("file::/d.rs::0", None, [1.0, 1.0])], STORE)
    assert search.search_store(many, files, q, 1, fetch=3, wide=10).count() == 0  # the 31st of thirty
    assert search.search_store(many, files, q, 1, fetch=3, wide=11).count() == 1
    assert search.search_store(many.limit(0), files, q).count() == 0


def test_a_learner_is_read_as_it_was_written(spark, tmp_path):
    q = spark.createDataFrame([(1, 0, 0.25, 3), (1, 1, -1.5, 0), (2, 0, None, 1)], "state long, action long, value double, visits long")
    seen = spark.createDataFrame([(1, 1, 0, 0.5, 2, False), (2, 2, 0, -0.5, None, True), (None, 1, 1, 0.0, 1, None)], "i long, state long, action long, reward double, next_state long, done boolean")
    path = str(tmp_path / "l")
    for rate in (-2.0, 0.3):
        learnloop.exported(q, seen, rate).write.mode("append").text(path)
    spark.createDataFrame([("no json",), ('{"other": 1}',), ("",)], "value string").write.mode("append").text(path)
    q2, seen2, rate = learnloop.imported(spark.read.text(path))
    assert sorted(map(str, q2.collect())) == sorted(map(str, q.collect()))
    assert sorted(map(str, seen2.select(*seen.columns).collect())) == sorted(map(str, seen.collect()))
    assert rate.first().exploration == 0.3
    assert [d.count() for d in learnloop.imported(spark.read.text(path).limit(0))] == [0, 0, 1]


def test_beliefs_come_once(spark):
    schema = "content string, confidence double, source string, timestamp long"
    none = spark.createDataFrame([], f"id string, {schema}")
    first = lifecycle.added_beliefs(none, spark.createDataFrame([("x", 2.0, "s", 2), ("x", 0.5, "s", 1), ("x", -1.0, "t", 1), (None, 1.0, "s", 1), ("", None, None, None)], schema))
    got = {(r.content, r.source): (r.confidence, r.timestamp) for r in first.collect()}
    assert got == {("x", "s"): (0.5, 1), ("x", "t"): (0.0, 1), ("", None): (0.0, None)}
    again = lifecycle.added_beliefs(first, spark.createDataFrame([("x", 0.9, "s", 0), ("y", 0.9, "s", 0)], schema))
    assert again.count() == first.count() + 1 and again.where("content = 'x' and source = 's'").first().confidence == 0.5


def test_introspection_of_nothing_and_something(spark):
    e = spark.range(0)
    goals = spark.createDataFrame([("Active",), ("Pending",), ("Completed",), (None,)], "status string")
    sync = spark.createDataFrame([(0.75,)], "synchrony double")
    none = browse.introspection(e, e, goals.limit(0), e, e, sync).first()
    assert (none.memories, none.active_goals, none.trend) == (0, 0, "stable")
    some = browse.introspection(e, e, goals, spark.range(5), spark.range(11), sync, 3).first()
    assert (some.active_goals, some.experiences, some.trend) == (2, 3, "improving")
    assert browse.introspection(e, e, goals, spark.range(5), spark.range(2), sync.select(F.lit(0.1).alias("synchrony")), 3).first().trend == "declining"
    assert search.sample(spark.range(100), 7, "id").collect() == search.sample(spark.range(100).repartition(5), 7, "id").collect()


def test_parts_of_words_only_where_no_whole_words_are(spark):
    rows = spark.createDataFrame([(1, "the cat sat", "dog"), (2, "concatenate", None), (3, "a Cat", "hot dogs"), (4, None, "")], "id long, a string, b string")
    index = wordindex.postings(rows, ["id"], ["a", "b"])
    at = lambda *q, **o: [(r.id, r.whole) for r in wordindex.first_found(index, wordindex.dictionary(index), *q, **o).collect()]
    assert at("cat", "id") == [(1, True), (3, True)] and at("cat", "id", limit=1) == [(1, True)]
    assert at("caten", "id") == [(2, False)] and at("dog", "id", "a") == [] and at("ot dog", "id", "b") == [(3, False)]
    assert at("", "id") == at("cat", "id", "c") == []
