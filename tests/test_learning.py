"""The learn loop and the pattern bank against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallweave.operators import learnloop
from recallweave.operators.patternbank import PatternBank

EXPERIENCE = "i long, state long, action long, reward double, next_state long, done boolean"


def unit(text):
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 1) / 16**13


def test_learn_equals_a_loop(spark):
    rows = [(i, i % 7 if i % 3 else 0, i % 2, (i % 5) / 4, (i * 3 + 1) % 7, None if i % 11 == 0 else i % 9 == 0) for i in range(120)]
    bad = [(None, 1, 1, 1.0, 1, False), (500, None, 1, 1.0, 1, False), (501, 1, None, 1.0, 1, False), (502, 1, 1, None, 1, False)]
    q = spark.createDataFrame([(s, 0, s / 10, 0) for s in range(7)], "state long, action long, value double, visits long")
    got, told = learnloop.learn(spark.createDataFrame(rows + bad, EXPERIENCE).repartition(5), q, 4, batch=20, buffer=80, rate=0.1)
    seen, buffer = {}, []
    for i, s, a, reward, after, done in rows:
        v = seen[s] = seen.get(s, -1) + 1
        total = reward + 0.5 * (1 if v == 0 else 1 / (1 + math.sqrt(v)))
        buffer.append((i, s, a, total, after, bool(done)))
    buffer, values, visits, errors = buffer[-80:], {(s, 0): s / 10 for s in range(7)}, {}, []
    for r in range(4):
        drawn = sorted(buffer, key=lambda b: (-math.log(unit(f"{1 + r}|{b[0]}")) / (abs(b[3]) + 0.01), b[0]))[:20]
        best = {}
        for (s, _), v in values.items():
            best[s] = max(v, best.get(s, -math.inf))
        by = {}
        for _, s, a, total, after, done in drawn:
            by.setdefault((s, a), []).append(total + 0.99 * (0 if done else best.get(after, 0)) - values.get((s, a), 0))
        errors.append(sum(sum(e) for e in by.values()) / 20)
        for pair, e in by.items():
            values[pair] = values.get(pair, 0) + 0.1 * sum(e) / len(e)
            visits[pair] = visits.get(pair, 0) + len(e)
    assert {(r.state, r.action): (pytest.approx(r.value), r.visits) for r in got.collect()} == {k: (v, visits.get(k, 0)) for k, v in values.items()}
    assert [(r.round, r.drawn, pytest.approx(r.error)) for r in told.orderBy("round").collect()] == [(n + 1, 20, e) for n, e in enumerate(errors)]


def test_learn_stops_and_needs_a_batch(spark):
    rows = spark.createDataFrame([(i, 0, 0, 0.5, 0, True) for i in range(40)], EXPERIENCE)
    q = spark.createDataFrame([], "state long, action long, value double, visits long")
    got, told = learnloop.learn(rows, q, 3, batch=41)
    assert got.count() == 0 and told.count() == 0
    _, told = learnloop.learn(rows, q, 9, rate=1.0, curiosity_weight=0.0, tolerance=0.01)
    assert told.count() == 2  # the first round learns it, the second finds no error
    state_plan = got._jdf.queryExecution().toString()
    assert "Join" not in state_plan  # a written table, not a chain of steps


def test_chosen_actions(spark):
    q = spark.createDataFrame([(s, a, float(a == 2)) for s in range(3000) for a in range(4)] + [(9999, 5, None)], "state long, action long, value double")
    rows = learnloop.chosen(q, 1, 0.2, 0.5).where("state < 3000").collect()
    assert all(r.best == 2 for r in rows)
    explored = sum(r.epsilon_action != 2 for r in rows) / 3000
    assert abs(explored - 0.15) < 0.03  # a quarter of the draws falls on the best one again
    want = math.exp(2) / (math.exp(2) + 3)
    assert abs(sum(r.softmax_action == 2 for r in rows) / 3000 - want) < 0.04
    assert learnloop.chosen(q, 1).where("state = 9999").first().best == 5
    assert learnloop.chosen(q, 1, 0.0).where("epsilon_action <> best").count() == 0


def _clusters(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8, 5)) * 10
    return spark.createDataFrame([(f"t{i}", (x[i % 8] + rng.normal(size=5) * 0.1).tolist(), (i % 8) / 7) for i in range(n)], "id string, vector array<double>, quality double")


def test_bank_moves_and_restarts(spark, tmp_path):
    t = _clusters(spark)
    odd = spark.createDataFrame([("a", None, 0.5), ("b", [1.0, None, 1.0, 1.0, 1.0], 0.5), ("c", [float("nan")] * 5, 0.5), ("d", [1.0], 0.5), ("e", [1.0] * 5, None), ("f", [float("inf")] * 5, 1.0)], t.schema)
    bank = PatternBank(spark, str(tmp_path / "bank"), 8)
    bank.bootstrap(t.unionByName(odd.where("id <> 'd'")), "id")
    assert bank.record(t.where("hash(id) % 2 = 0").unionByName(odd), 1) and bank.record(t.where("hash(id) % 2 <> 0"), 2)
    before = sorted(map(tuple, bank.patterns(0.0).collect()))
    again = PatternBank(spark, str(tmp_path / "bank"), 8)  # a new process finds the state, and a repeated batch changes nothing
    assert not again.record(t, 2) and sorted(map(tuple, again.patterns(0.0).collect())) == before
    assert [r["size"] for r in again.patterns(0.0).collect()] == [50] * 8  # drawn by distance, each cluster has its centre
    assert sorted(round(r.quality, 6) for r in again.patterns(0.3).collect()) == [round(i / 7, 6) for i in range(3, 8)]
    means = sorted(tuple(np.round(np.mean([r.vector for r in t.collect() if abs(r.quality - i / 7) < 1e-9], axis=0), 6)) for i in range(8))
    assert sorted(tuple(np.round(r.vector, 6)) for r in again.patterns(0.0).collect()) == means
    copy = PatternBank(spark, str(tmp_path / "copy"), 8)
    copy.restore(again.patterns(0.0))
    copy.record(t.limit(1), 1)
    assert copy.state().agg(F.sum("size")).first()[0] == 401
    with pytest.raises(ValueError):
        copy.restore(again.patterns(0.0))


def test_bank_without_rows(spark, tmp_path):
    none = _clusters(spark).where("false")
    bank = PatternBank(spark, str(tmp_path), 4)
    with pytest.raises(ValueError):
        bank.record(none, 1)
    bank.bootstrap(none, "id")
    assert bank.record(_clusters(spark), 1) and bank.patterns(0.0).count() == 0


def test_bank_takes_equal_vectors_and_weights(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), [1.0, 2.0], 0.5, 3.0) for i in range(20)] + [("x", [5.0, 5.0], 1.0, 0.0)], "id string, vector array<double>, quality double, weight double")
    bank = PatternBank(spark, str(tmp_path), 4)
    bank.bootstrap(rows, "id")
    bank.record(rows, 1)
    assert [tuple(r) for r in bank.state().collect()] == [(0, [1.0, 2.0], 60.0, 0.5, 20)]
