"""Streams over several files against their batch counterparts."""

import random
import uuid

from pyspark.sql import functions as F

from provspark.operators import donations as D
from provspark.operators import ledger as L
from provspark.operators.quotas import Quota, over_quota
from provspark.streaming import jobs as S

VOTES = "event_id bigint, s bigint, image_id bigint, voter_id string, choice string"


def _write(spark, rows, schema, folder, name):
    df = spark.createDataFrame(rows, schema)
    if "s" in df.columns:
        df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(f"{folder}/{name}")
    return df


def test_votes_in_many_files(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, 1700000000 + i * 10, rng.randint(1, 5), f"v{rng.randint(1, 4)}", rng.choice(["real", "edited", "ai", "unsure"])) for i in range(240)]
    parts = [_write(spark, rows[i * 60:(i + 1) * 60], VOTES, tmp_path / "in", f"p{i}") for i in range(4)]
    # The second part arrives once more: nothing may change.
    parts[1].coalesce(1).write.parquet(str(tmp_path / "in" / "p9"))
    stream = S.read_events(spark, str(tmp_path / "in" / "*"), "*.parquet", parts[0].schema, files_per_trigger=1)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    known = parts[0].select("image_id").where("image_id <> 5").distinct()
    S.run_updates_to_files(S.vote_states(stream, known), out, ck)
    events = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    want = {tuple(r) for r in L.vote_counts(L.current_votes(events, known)).collect()}
    assert {tuple(r) for r in L.vote_counts(S.latest_states(spark, out)).collect()} == want
    assert {r[0] for r in want} == {1, 2, 3, 4}
    # A restart with nothing new changes nothing.
    S.run_updates_to_files(S.vote_states(stream, known), out, ck)
    assert {tuple(r) for r in L.vote_counts(S.latest_states(spark, out)).collect()} == want


def test_donations(spark, tmp_path):
    rows = [(i, a) for i, a in enumerate(["10.005", "5", "", "ten", "-3", "0.50"])]
    df = _write(spark, rows, "payment_id bigint, amount string", tmp_path / "in", "p0")
    stream = S.read_events(spark, str(tmp_path / "in" / "*"), "*.parquet", df.schema)
    name = f"d{uuid.uuid4().hex}"
    S.run_to_memory(S.donation_stream(stream), name, str(tmp_path / "ck"))
    assert spark.table(name).first().total_cents == 1001 + 500 + 50 == D.donation_total(df).first().total_cents


def test_late_requests_are_dropped(spark, tmp_path):
    schema = "event_id bigint, s bigint, key bigint"
    a = _write(spark, [(1, 100, 1), (2, 200, 1), (3, 4000, 1), (4, 9000, 1)], schema, tmp_path / "in", "p0")
    stream = S.read_events(spark, str(tmp_path / "in" / "*"), "*.parquet", a.schema, files_per_trigger=1)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    S.run_to_files(S.quota_counts(stream, 3600), out, ck)
    _write(spark, [(5, 300, 1), (6, 20000, 1)], schema, tmp_path / "in", "p1")
    S.run_to_files(S.quota_counts(stream, 3600), out, ck)
    got = sorted((r.window_start_s, r.requests) for r in spark.read.schema("key bigint, window_start_s bigint, requests bigint").parquet(out).collect())
    assert got == [(0, 2), (3600, 1), (7200, 1)]


def test_runs_of_updates_are_merged(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, 1700000000 + i, rng.randint(1, 3), f"v{rng.randint(1, 3)}", rng.choice(["real", "edited", "ai"])) for i in range(110)]
    parts = [_write(spark, rows[i * 10:(i + 1) * 10], VOTES, tmp_path / "in", f"p{i:02}") for i in range(11)]
    known = parts[0].union(parts[1]).select("image_id").distinct()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream = S.read_events(spark, str(tmp_path / "in" / "*"), "*.parquet", parts[0].schema, files_per_trigger=1)
    S.run_updates_to_files(S.vote_states(stream, known), out, ck, fan=3)
    held, replaced = S.update_runs(spark, out)
    assert held == ["run=0-8", "run=9-9", "run=10-10"] and not replaced
    events = spark.createDataFrame(rows, VOTES).withColumn("ts", F.timestamp_seconds("s"))
    want = {tuple(r) for r in L.vote_counts(L.current_votes(events, known)).collect()}
    assert {tuple(r) for r in L.vote_counts(S.latest_states(spark, out)).collect()} == want
    # An unfinished run is not read.
    (tmp_path / "out" / "run=9-11").mkdir()
    assert S.update_runs(spark, out)[0] == held


def test_nothing_was_streamed_yet(spark, tmp_path):
    q = Quota("q", 1, 60, True)
    assert not S.latest_states(spark, str(tmp_path / "none")).collect()
    assert not S.settled_flags(spark, str(tmp_path / "none"), q).collect()


def test_repeated_event_ids_within_the_watermark(spark, tmp_path):
    # The second of the same id would win by time if it counted.
    a = _write(spark, [(1, 1000, 7, "v", "real")], VOTES, tmp_path / "in", "p0")
    stream = S.read_events(spark, str(tmp_path / "in" / "*"), "*.parquet", a.schema, files_per_trigger=1)
    known, out, ck = a.select("image_id"), str(tmp_path / "out"), str(tmp_path / "ck")
    S.run_updates_to_files(S.vote_states(stream, known, "1 hour"), out, ck)
    _write(spark, [(1, 1010, 7, "v", "ai"), (2, 1005, 7, "w", "ai")], VOTES, tmp_path / "in", "p1")
    S.run_updates_to_files(S.vote_states(stream, known, "1 hour"), out, ck)
    assert {tuple(r) for r in S.latest_states(spark, out).collect()} == {(7, "v", "real"), (7, "w", "ai")}


def test_quota_flags_of_many_batches_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(4)
    schema = "event_id bigint, s bigint, key bigint"
    # Out of order by at most 500 s; half of all requests have one key.
    times = sorted(rng.randint(0, 9000) for _ in range(400))
    rows = [(i, t, rng.choice([1, 1, 1, 2, 3, None])) for i, t in enumerate(times)]
    rows.sort(key=lambda r: r[1] + rng.randint(0, 500))
    parts = [_write(spark, rows[i * 100:(i + 1) * 100], schema, tmp_path / "in", f"p{i}") for i in range(4)]
    stream = S.read_events(spark, str(tmp_path / "in" / "*"), "*.parquet", parts[0].schema, files_per_trigger=1)
    everything = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    for q in (Quota("key", 5, 600, True), Quota("all", 40, 1800, False)):
        path = str(tmp_path / q.name)
        S.run_quota_flags(stream, q, f"{path}/out", f"{path}/ck")
        closed = max(times) - 600
        want = {tuple(r) for r in over_quota(everything, (q,)).collect() if r.window_start_s + q.seconds <= closed}
        assert {tuple(r) for r in S.settled_flags(spark, f"{path}/out", q).collect()} == want
        assert len(want) > 20
        kept = spark.read.parquet(f"{path}/out/state=3").groupBy("scope", "window_no").count()
        assert max(r[2] for r in kept.collect()) == q.limit
        # A restart without new requests changes nothing; a late one for a closed window is dropped.
        S.run_quota_flags(stream, q, f"{path}/out", f"{path}/ck")
        assert S.settled_flags(spark, f"{path}/out", q).count() == len(want)
    _write(spark, [(1000, 10, 1), (1001, 20000, 1)], schema, tmp_path / "in", "p9")
    q = Quota("key", 5, 600, True)
    S.run_quota_flags(stream, q, f"{tmp_path}/key/out", f"{tmp_path}/key/ck")
    got = {r.event_id for r in S.settled_flags(spark, f"{tmp_path}/key/out", q).collect()}
    assert got == {r.event_id for r in over_quota(everything, (q,)).collect()}
