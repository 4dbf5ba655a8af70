"""The learn loop: Q-values trained in rounds over a replay buffer, and the actions that they lead to.

A round draws a batch by priority, makes one temporal-difference step for all of it at once, and writes the new Q-values as a table that the
next round reads, so lineage never grows and a lost executor costs one round. Nothing but a round's count and error reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..sources.scratch import forget, written
from . import selection
from .learning import weighted_sample

#: A mean error below this counts as a fixed point.
CONVERGED = 0.01

Q_COLUMNS = ("state", "action", "value", "visits")
EXPERIENCE_COLUMNS = ("i", "state", "action", "reward", "next_state", "done")


def uniform(seed: int, *parts: Column) -> Column:
    """A number from 0 (never reached) to 1 that a hash of the parts gives."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(16**13))


def rewarded(experiences: DataFrame, buffer: int = 10_000, curiosity_weight: float = 0.5) -> DataFrame:
    """The newest `buffer` of experiences (i, state, action, reward, next_state, done) with `total`, the reward and the bonus that the earlier
    visits of the state leave, and `priority`. A null in i, state, action or reward takes a row out; a null `done` is false. States are numbered by ranges,
    so one state may hold most rows. Visits are counted over all rows, also those that have left the buffer."""
    whole = experiences.where("i is not null and state is not null and action is not null and reward is not null").withColumn("done", F.coalesce("done", F.lit(False)))
    seen = selection.numbered(whole, [F.col("i")], ["state"], "__n")
    total = F.col("reward") + curiosity_weight * labels.curiosity(F.col("__n") - 1)
    newest = seen.withColumn("total", total).withColumn("priority", F.abs("total") + 0.01).drop("__n")
    return newest.orderBy(F.desc("i")).limit(buffer)


def step(q: DataFrame, batch: DataFrame, rate: float = 0.01, discount: float = 0.99) -> DataFrame:
    """q (state, action, value, visits) after a batch, with `n`, the batch's rows of a pair, and `error`, their mean error before the step.
    A pair's errors are averaged, so no order counts; unknown pairs and next states stand at 0."""
    q = q.select("state", "action", "value", "visits")
    best = q.groupBy(F.col("state").alias("next_state")).agg(F.max("value").alias("best"))
    target = F.col("total") + discount * F.when(F.col("done"), 0.0).otherwise(F.coalesce("best", F.lit(0.0)))
    targets = batch.join(best, "next_state", "left").groupBy("state", "action").agg(F.avg(target).alias("target"), F.count("*").alias("n"))
    old, n = F.coalesce("value", F.lit(0.0)), F.coalesce("n", F.lit(0))
    error = F.when(F.col("target").isNull(), 0.0).otherwise(F.col("target") - old)
    return q.join(targets, ["state", "action"], "full").select("state", "action", (old + rate * error).alias("value"), (F.coalesce("visits", F.lit(0)) + n).cast("bigint").alias("visits"), n.cast("bigint").alias("n"), error.alias("error"))


def learn(experiences: DataFrame, q: DataFrame, rounds: int, batch: int = 32, buffer: int = 10_000, rate: float = 0.01, discount: float = 0.99, curiosity_weight: float = 0.5, tolerance: float = 0.0, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(Q-values, rounds as round, drawn, error) after at most `rounds` rounds, fewer when a round's mean error falls below `tolerance`.
    Each draws `batch` rows without replacement, in proportion to their priority, by a hash of its number and `i`; ties of the hash go to the smaller i.
    Fewer experiences than a batch train nothing: the Q-values come back and no round is told. Tables of earlier rounds are deleted."""
    ready = written(rewarded(experiences, buffer, curiosity_weight), "replay")
    now = written(q, "q-values")
    told: list[tuple[int, int, float]] = []
    enough = ready.count() >= batch
    for r in range(rounds if enough else 0):
        after = written(step(now, weighted_sample(ready, batch, "priority", "i", seed + r), rate, discount), "q-values")
        forget(now)
        sums = after.agg(F.sum("n").alias("n"), F.sum(F.col("error") * F.col("n")).alias("e")).first()
        now, error = after, sums.e / sums.n
        told.append((r + 1, sums.n, error))
        if abs(error) < tolerance:
            break
    forget(ready)
    return now.select("state", "action", "value", "visits"), q.sparkSession.createDataFrame(told, "round int, drawn bigint, error double")


def chosen(q: DataFrame, turn: int, epsilon: float = 0.1, temperature: float = 1.0, seed: int = 1) -> DataFrame:
    """For each state of q the `best` action, the action `epsilon_action` that explores in a share of epsilon of the draws, and `softmax_action`, drawn in
    proportion to exp(value / temperature). A hash of the seed, the turn and the state (and action) draws, so a turn can be repeated.
    Ties go to the smaller action; null values stand for 0. Softmax is drawn by adding Gumbel noise, which needs no sum over a state."""
    value = F.coalesce("value", F.lit(0.0))
    noisy = value / temperature - F.log(-F.log(uniform(seed, F.lit(turn), F.col("state"), F.col("action")) * (1 - 1e-12)))
    states = q.groupBy("state").agg(
        F.max_by("action", F.struct(value, -F.col("action"))).alias("best"), F.max_by("action", F.struct(noisy, -F.col("action"))).alias("softmax_action"), F.array_sort(F.collect_set("action")).alias("actions")
    )
    u = uniform(seed, F.lit(turn), F.col("state"))
    at = F.least(F.floor(u / epsilon * F.size("actions")), F.size("actions") - 1).cast("int")
    return states.select("state", "best", F.when(u < epsilon, F.get("actions", at)).otherwise(F.col("best")).alias("epsilon_action"), "softmax_action")


def exported(q: DataFrame, experiences: DataFrame, exploration: float) -> DataFrame:
    """A learner as lines of JSON (value), which `imported` reads: its Q-values (state, action, value, visits), experiences (i, state, action, reward, next_state, done) and exploration rate."""
    rate = q.sparkSession.range(1).select(F.to_json(F.struct(F.lit(float(exploration)).alias("exploration"))).alias("value"))
    line = lambda df, kind, columns: df.select(F.to_json(F.struct(F.struct(*columns).alias(kind))).alias("value"))
    return line(q, "q", Q_COLUMNS).unionByName(line(experiences, "experience", EXPERIENCE_COLUMNS)).unionByName(rate)


def imported(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(q, experiences, rate) of lines that were exported; lines of other kinds and broken ones are passed over. rate has one row: the exploration rate, held to 0 to 1, or 0.1 without one.
    Of lines that are there twice, as after two exports into one folder, one counts: the Q-value with more visits, then the larger; experiences by their number."""
    schema = "q struct<state: bigint, action: bigint, value: double, visits: bigint>, experience struct<i: bigint, state: bigint, action: bigint, reward: double, next_state: bigint, done: boolean>, exploration double"
    rows = lines.select(F.from_json("value", schema).alias("x")).select("x.*")
    q = rows.where("q is not null").select("q.*").groupBy("state", "action").agg(F.max(F.struct("visits", "value")).alias("m")).select("state", "action", "m.value", "m.visits")
    seen = rows.where("experience is not null").select("experience.*").groupBy("i").agg(F.min(F.struct(*EXPERIENCE_COLUMNS[1:])).alias("r")).select("i", "r.*")
    rate = rows.agg(F.max("exploration").alias("r")).select(F.least(F.greatest(F.coalesce("r", F.lit(0.1)), F.lit(0.0)), F.lit(1.0)).alias("exploration"))
    return q, seen, rate
