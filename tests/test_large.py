"""What differs only on larger tables: many copies, rows beyond a sample, values that round to zero."""

import math

import numpy as np
from pyspark.sql import functions as F

from recallweave.functions import vectors
from recallweave.operators import chunking, counters, intake, neighbours, packs, patternbank, residualindex, search, wordindex
from recallweave.sources import store


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_pairs_of_many_copies(spark):
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(300, 6)))
    x[100:250] = x[0]
    ids, w = [f"m{i:03}" for i in range(len(x))], np.where(np.arange(len(x)) % 3 == 0, 0.5, 1.0)
    df = spark.createDataFrame([(i, v.tolist(), float(n)) for i, v, n in zip(ids, x, w, strict=True)], "id string, vector array<double>, w double")
    sims = np.round(x @ x.T, 12) * w
    want = {(ids[i], ids[j]) for i in range(len(x)) for j in [j for j in np.lexsort((np.arange(len(x)), -sims[i])) if j != i and sims[i, j] > 0.2][:4]}
    for how in ({}, {"only": df.select("id")}, {"block": 70}, {"block": 70, "only": df.select("id")}):
        assert {(r.src, r.dst) for r in search.pairs_above(df, 4, 0.2, weight="w", **how).collect()} == want


def test_a_row_goes_to_few_blocks(spark):
    """Each row is sent once to each block, so blocks of 4096 rows sent 40,000 rows ten times to others and ten times to the asked ones."""
    df = spark.range(40_000).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), F.rand(3)).alias("vector"))
    found = search.pairs_above(df, 1, 2.0, only=df.select("id"))
    assert found.count() == 0
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "sequence(0, 3" in plan and "sequence(0, 7" in plan


def test_equal_up_to_digits(spark):
    rows = [("a", [1.0, 2.0, 3.0]), ("b", [0.1, 0.2, 0.3]), ("c", [0.7, 1.4, 2.1]), ("d", [1.0, 2.0, 3.0000001])]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    found = search.pairs_above(df, 1, 0.5, digits=9).collect()
    assert {(r.src, r.dst) for r in found} == {("a", "b"), ("b", "a"), ("c", "a"), ("d", "a")}


def test_zeros_keep_their_sign(spark):
    got = spark.range(1).select(vectors.rounded(F.array(*[F.lit(x) for x in (-1e-9, 1e-9, -5e-7, 0.1234565, -2.5)])).alias("v")).first().v
    assert got == [0.0, 0.0, -1e-06, 0.123457, -2.5] and [math.copysign(1, x) for x in got[:2]] == [-1, 1]


def test_bootstrap_over_all_rows(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(6000, 3))
    df = spark.createDataFrame([(f"t{i}", v.tolist(), 1.0) for i, v in enumerate(x)], "id string, vector array<double>, quality double")
    bank = patternbank.PatternBank(spark, str(tmp_path), 4)
    bank.bootstrap(df, "id", most=None, rounds=1, spread=False)
    got = np.array([r.vector for r in bank.state().orderBy("centre").collect()])
    key = lambda i: F.conv(F.substring(F.md5(i), 1, 13), 16, 10).cast("double")
    first = np.array([r.vector for r in df.orderBy(key("id")).limit(4).select("vector").collect()])
    at = ((x[:, None] - first) ** 2).sum(2).argmin(1)
    assert np.allclose(got, [x[at == c].mean(0) for c in range(4)])


def test_lists_grow_until_neighbours_are_found(spark):
    x = unit(np.random.default_rng(4).normal(size=(1500, 48)))
    df = spark.createDataFrame([(f"m{i}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    exact = {(r.src, r.dst) for r in search.pairs_above(df, 5, -2.0).collect()}
    found = {(r.src, r.dst) for r in neighbours.descent(df, 5, -2.0, width=6, rounds=3).collect()}
    assert len(found) == len(exact) and len(exact & found) >= 0.9 * len(exact)


def test_postings_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "b a B", None), (2, None, "x"), (3, "", "a")], "k int, t string, u string")
    found = wordindex.postings(rows, ["k"], ["t", "u"])
    got = sorted((r.k, r.field, r.word, r.positions) for r in found.collect())
    assert got == [(1, "t", "a", [1]), (1, "t", "b", [0, 2]), (2, "u", "x", [0]), (3, "u", "a", [0])]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert wordindex.postings(rows.limit(0), ["k"], ["t"]).count() == 0


def test_a_products_tile_serves_both_sides_and_each_pair_of_blocks_has_its_partition(spark):
    """Both directions from one pass over the tiles equal brute force, over several tiles, with copies, ties and weights; pairs of blocks don't share a task."""
    rng = np.random.default_rng(4)
    x, y = (rng.integers(-2, 3, (n, 8)).astype(float) + 0.01 for n in (search.TILE + 300, search.TILE + 77))
    x[5:40], y[900:950] = x[0], x[0]
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    wx, wy = np.linspace(0.5, 1, len(x)), np.linspace(1, 0.5, len(y))
    for weights in ((None, None), (wx, wy)):
        for (row, col, sim), (a, b, w) in zip(search._best(x, y, weights, 4, 0.3, 9), ((x, y, weights[1]), (y, x, weights[0])), strict=True):
            s = np.einsum("id,jd->ij", a, b) * (1.0 if w is None else w)
            best = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :4]
            want = [(i, int(j)) for i in range(len(a)) for j in best[i] if s[i, j] > 0.3]
            assert list(zip(row.tolist(), col.tolist(), strict=True)) == want
            assert np.allclose(sim, s[row, col], rtol=0, atol=1e-12)
    df = spark.createDataFrame([(f"r{i:03d}", v.tolist()) for i, v in enumerate(x[:60])], "id string, vector array<double>")
    # Nine blocks have 45 pairs: so many partitions compare them, whatever the number of shuffle partitions.
    plan = search.pairs_above(df, 3, 0.2, block=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 45" in plan


def test_a_text_is_split_once_for_all_its_chunks(spark):
    """Splitting it again for each chunk made the work grow with the square of a text's length."""
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(2000))), (2, " a "), (3, ""), (4, None)], "k int, t string")
    found = chunking.chunk(df, "t", 100, 20)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    rows = {(r.k, r.chunk_index): r.chunk for r in found.collect()}
    assert len(rows) == 26 and rows[2, 0] == "a" and all(rows[1, i].split(" ")[0] == f"w{80 * i}" for i in range(25))
    few = {(r.k, r.chunk_index): r.chunk for r in chunking.chunk(df, "t", 100, 20, 3).collect()}
    assert few == {k: v for k, v in rows.items() if k[1] < 3}


def test_coded_rows_are_ranked_by_slices():
    """A batch's distances were all held at once; slices give the same nearest rows."""
    rng = np.random.default_rng(6)
    model = residualindex.Model.learn(rng.normal(size=(400, 8)), 2, 4, 16, 1)
    q, codes = rng.normal(size=(900, 8)), rng.integers(0, 3, (3000, 4)).astype(np.uint8)  # many are equal
    held = []
    whole = model.distances
    model.distances = lambda a, c, b: held.append(len(a) * len(b)) or whole(a, c, b)
    at, far = model.nearest_coded(q, 1, codes, 30)
    d = whole(q, 1, codes)
    assert max(held) <= residualindex.HELD < d.size
    assert np.allclose(np.sort(far, axis=1), np.sort(d, axis=1)[:, :30]) and np.array_equal(np.take_along_axis(d, at.astype(int), 1), far)
    assert np.array_equal(np.sort(at, axis=1), np.sort(np.argsort(d, axis=1, kind="stable")[:, :30], axis=1))  # of equal ones the first


def test_many_rows_are_packed_and_not_sent_to_blocks(spark, monkeypatch):
    """With more than SENT rows to send, no row is sent to each block; what is found equals brute force, with copies over several packs, ties, weights and few that ask."""
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (700, 6)).astype(float) + 0.01
    x[100:160], x[300:420] = x[0], x[1]
    x[5] *= 3.0  # the same direction, not a copy
    w = np.where(np.arange(len(x)) % 3 == 0, 0.5, 1.0)
    w[150:160] = 0.5
    ids = [f"m{i:03}" for i in rng.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), float(n)) for i, v, n in zip(ids, x, w, strict=True)], "id string, vector array<double>, w double")
    y, name = unit(x), np.array(ids)
    sims = np.round(y @ y.T * w, 9)
    best = {ids[i]: [ids[j] for j in np.lexsort((name, -sims[i])) if j != i and sims[i, j] > 0.2][:4] for i in range(len(x))}
    some = df.where("w = 0.5 or id < 'm100'").select("id")
    for only in (None, some):
        want = {(i, j) for i, js in best.items() for j in js if only is None or w[ids.index(i)] == 0.5 or i < "m100"}
        own = df.select("id", F.col("vector").alias("v"), "w")
        assert {(r.src, r.dst) for r in packs.nearest(own, 4, 0.2, 9, only, size=90).collect()} == want
        monkeypatch.setattr(search, "SENT", 500, raising=False)
        found = search.pairs_above(df, 4, 0.2, weight="w", digits=9, only=only)
        assert "sequence(" not in found._jdf.queryExecution().analyzed().toString()
        assert {(r.src, r.dst) for r in found.collect()} == want


def test_new_memories_are_searched_without_their_texts(spark, tmp_path, monkeypatch):
    """What the search reads several times has no texts to sort out again; its result is the same."""
    tables = store.TableStore(spark, str(tmp_path))
    texts = spark.createDataFrame([(f"t{i}", f"one text of several, number {i % 3} of them", "episodic", 0.5, i) for i in range(9)], "id string, content string, memory_type string, importance double, timestamp long")
    plans, whole = [], search.pairs_above
    monkeypatch.setattr(search, "pairs_above", lambda rows, *a, **b: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or whole(rows, *a, **b))
    intake.remember_texts(tables, texts.where("timestamp < 5"), counters.Counters(spark), above=0.7)
    assert intake.remember_texts(tables, texts, counters.Counters(spark), above=0.7) == {"created": 4, "skipped": 5}
    assert len(plans) == 2 and not any("content" in p or "Aggregate" in p for p in plans)
    found = {r.src: r.dst for r in tables.read("edges", ["src", "dst"]).where("similarity > 0.999999").orderBy("src", F.desc("dst")).collect()}
    assert found == {"t0": "t3", "t1": "t4", "t3": "t0", "t4": "t1", "t5": "t2", "t6": "t0", "t7": "t1", "t8": "t2"}


def test_lists_end_where_all_pairs_are_less_work(spark, monkeypatch):
    """Vectors without clusters need ever longer lists; they aren't built where moving vectors to them costs more than all pairs."""
    x = unit(np.random.default_rng(4).normal(size=(700, 48)))
    df = spark.createDataFrame([(f"m{i}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    exact = {(r.src, r.dst) for r in search.pairs_above(df, 5, 0.1).collect()}
    seeded, widths = neighbours._seeded, []
    monkeypatch.setattr(neighbours, "_seeded", lambda own, graph, width, *a: widths.append(width) or seeded(own, graph, width, *a))
    for moves, want in ((700 * 3 * 6 * 2, [6]), (0, [])):
        monkeypatch.setattr(neighbours, "MOVES", moves, raising=False)
        widths.clear()
        assert {(r.src, r.dst) for r in neighbours.descent(df, 5, 0.1, width=6, rounds=2).collect()} == exact
        assert widths == want
