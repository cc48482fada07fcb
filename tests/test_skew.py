"""Sliced window helpers against plain windows."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provspark.operators import ledger as L
from provspark.operators import quotas as Q
from provspark.operators import skew as K


def _events(spark, n=600, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        rows.append((i, 1700000000 + rng.randint(0, 90000) // 50 * 50, 1 if hot else rng.randint(2, 9),
                     "v1" if hot else f"v{rng.randint(1, 4)}", rng.choice(["real", "edited", "ai", "unsure"])))
    df = spark.createDataFrame(rows, "event_id bigint, s bigint, image_id bigint, voter_id string, choice string")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_sliced_lag_equals_lag(spark):
    ev = _events(spark)
    w = Window.partitionBy("image_id", "voter_id").orderBy("ts", "event_id")
    want = {(r.event_id, r.p) for r in ev.select("event_id", F.lag("choice").over(w).alias("p")).collect()}
    for seconds in (60, 3600, 10**7):
        cut = ev.withColumn("slice", K.time_slice(F.col("ts"), seconds))
        got = K.sliced_lag(cut, ["image_id", "voter_id"], "slice", ["ts", "event_id"], "choice", "p")
        assert {(r.event_id, r.p) for r in got.collect()} == want


def test_sliced_row_number_equals_row_number(spark):
    ev = _events(spark)
    w = Window.partitionBy("image_id").orderBy(F.desc("ts"), F.asc("event_id"))
    want = {(r.event_id, r.rn) for r in ev.select("event_id", F.row_number().over(w).alias("rn")).collect()}
    cut = -K.time_slice(F.col("ts"), 900)
    got = K.sliced_row_number(ev, ["image_id"], [cut], [F.desc("ts"), F.asc("event_id")], "rn")
    assert {(r.event_id, r.rn) for r in got.collect()} == want


def test_dense_ids(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(500)], "key string")
    ids = sorted(r.id for r in K.dense_ids(keys, "key", 100, "id").collect())
    assert ids == list(range(101, 601))


def test_vote_replay_statuses(spark, table):
    ev = table(
        "event_id bigint, s bigint, image_id bigint, voter_id string, choice string",
        (1, 0, 7, "a", "real"), (2, 5000, 7, "a", "real"), (3, 9000, 7, "a", "ai"), (4, 9000, 7, "a", "maybe"),
        (5, 9001, 8, "a", "ai"), (6, 9002, 7, "b", "edited"),
    ).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    known = table("image_id bigint", (7,))
    got = {r.event_id: (r.status, r.previous) for r in L.vote_replay(ev, known).collect()}
    assert got == {
        1: ("recorded", None), 2: ("unchanged", "real"), 3: ("updated", "real"), 4: ("rejected", None),
        5: ("rejected", None), 6: ("recorded", None),
    }
    counts = L.vote_counts(L.current_votes(ev, known)).collect()
    assert [tuple(r) for r in counts] == [(7, 0, 1, 1)]


def test_over_quota(spark):
    ev = _events(spark).select("event_id", F.col("image_id").alias("key"), "ts")
    rule = Q.Quota("r", 3, 3600, True)
    w = Window.partitionBy("key", K.time_slice(F.col("ts"), 3600)).orderBy("ts", "event_id")
    want = {r.event_id for r in ev.withColumn("rn", F.row_number().over(w)).filter("rn > 3").collect()}
    assert {r.event_id for r in Q.over_quota(ev, (rule,)).collect()} == want
