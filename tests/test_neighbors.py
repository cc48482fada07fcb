"""The hash join against brute force, with and without split buckets, and its plan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from provspark.functions import hashing as H
from provspark.operators import neighbors as N


def _hashes(n, seed, shared=0.3):
    """Random words, near copies of each other, and a third that share most of their bits."""
    rng = random.Random(seed)
    base = rng.getrandbits(64)
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.4:
            word = rng.choice(out)
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                word ^= 1 << bit
        elif kind < 0.4 + shared:
            word = (base & ~0xFFFF) | rng.getrandbits(16)
        else:
            word = rng.getrandbits(64)
        out.append(word)
    return out


def _rows(n, seed):
    p, w = _hashes(n, seed), _hashes(n, seed + 1)
    return [(i, f"{a:016x}", f"{b:016x}") for i, (a, b) in enumerate(zip(p, w))]


def _brute(q, r):
    out = set()
    for qi, qp, qw in q:
        for ri, rp, rw in r:
            pd = bin(int(qp, 16) ^ int(rp, 16)).count("1")
            wd = bin(int(qw, 16) ^ int(rw, 16)).count("1")
            if pd <= 4 or wd <= 3:
                out.add((qi, ri, pd, wd))
    return out


@pytest.mark.parametrize("kept", [1, 2, 3])
def test_equals_brute_force(spark, kept):
    q, r = _rows(150, 7), _rows(220, 11) + [(1000 + i, p, w) for i, p, w in _rows(60, 7)]
    qs = spark.createDataFrame(q, "query_id bigint, phash string, whash string")
    rs = spark.createDataFrame(r, "image_id bigint, phash string, whash string")
    got = N.hash_neighbors(qs, rs, kept=kept).collect()
    assert len(got) == len(set(got))
    assert {tuple(x) for x in got} == _brute(q, r)


def test_unusable_hashes(spark):
    good, other = "00000000000000ff", "ffffffffffffff00"
    qs = spark.createDataFrame([(1, good, good), (2, good, "zz"), (3, None, good)], "query_id bigint, phash string, whash string")
    rs = spark.createDataFrame(
        [(1, good, good), (2, None, good), (3, other, good), (4, "", good), (5, other, None), (6, "12", good), (7, good, "bad")],
        "image_id bigint, phash string, whash string",
    )
    got = {(x.query_id, x.neighbor_id, x.whash_distance) for x in N.hash_neighbors(qs, rs).collect()}
    assert got == {(1, 1, 0), (1, 3, 0), (1, 7, None), (2, 1, None), (2, 7, None)}


def test_plan_has_no_cartesian_product(spark):
    rs = spark.createDataFrame(_rows(50, 3), "image_id bigint, phash string, whash string")
    qs = rs.withColumnRenamed("image_id", "query_id")
    plan = N.hash_neighbors(qs, rs)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_plan_is_the_same_at_all_sizes_and_runs_no_job(spark):
    def shape(n):
        rs = spark.range(n).select(F.col("id").alias("image_id"), F.lpad(F.hex("id"), 16, "0").alias("phash"), F.lit("00000000000000ff").alias("whash"))
        spark.sparkContext.setJobGroup(f"size-{n}", "plan")
        plan = N.hash_neighbors(rs.withColumnRenamed("image_id", "query_id"), rs)._jdf.queryExecution().optimizedPlan().toString()
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"size-{n}")
        return [re.findall(r"[A-Z]\w+", line)[:1] for line in plan.splitlines()]

    try:
        assert shape(1_000) == shape(1_000_000)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("k,kept", [(4, 1), (4, 2), (3, 2), (4, 3)])
def test_block_masks_cover(k, kept):
    masks = H.block_masks(k, kept)
    rng = random.Random(k * 10 + kept)
    for _ in range(300):
        x = 0
        for bit in rng.sample(range(64), k):
            x |= 1 << bit
        assert any(x & m == 0 for m in masks)


def test_hybrid_and_local_methods(spark):
    pairs = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 1, 9)], "query_id bigint, neighbor_id bigint, phash_distance int, whash_distance int")
    local = spark.createDataFrame([(1, 2, 20), (1, 3, 18)], "query_id bigint, neighbor_id bigint, inliers bigint")
    got = {(r.neighbor_id, r.match_method) for r in N.with_local_matches(pairs, local).collect()}
    assert got == {(1, "hash"), (2, "hybrid"), (3, "local")}


def test_display(one):
    schema = "p int, w int, np string, nw string"

    def show(p, w, np, nw):
        return H.hash_display(np, nw, p, w)

    assert one(show, schema, 3, 2, "aa", "bb") == "bb (whash)"
    assert one(show, schema, 2, 2, "aa", "bb") == "bb (whash)"
    assert one(show, schema, 1, 2, "aa", "bb") == "aa (phash)"
    assert one(show, schema, None, None, "aa", None) == "aa (phash)"
    assert one(lambda p, w, a, b: H.display_distance(p, w), schema, None, None, "aa", None) == 0
    assert one(lambda p, w, a, b: H.display_distance(p, w), schema, None, 5, "aa", "bb") == 5


def test_decode(one):
    assert one(H.decode_hash, "h string", "ffffffffffffffff") == -1
    assert one(H.decode_hash, "h string", "8000000000000000") == -(1 << 63)
    assert one(H.decode_hash, "h string", "00000000000000FF") == 255
    for bad in ("zz00000000000000", "", "123", None, "00000000000000ff0"):
        assert one(H.decode_hash, "h string", bad) is None


def test_unique_under_repeat(spark):
    rows = [(i, "0" * 16, "0" * 16) for i in range(40)]
    qs = spark.createDataFrame(rows, "query_id bigint, phash string, whash string")
    rs = spark.createDataFrame([(1, "0" * 16, "f" * 16), (2, "f" * 16, "0" * 16)], "image_id bigint, phash string, whash string")
    out = N.hash_neighbors(qs, rs).groupBy("neighbor_id").agg(F.count("*").alias("n")).collect()
    assert {(r.neighbor_id, r.n) for r in out} == {(1, 40), (2, 40)}


def test_sums_equal_pairs(spark):
    """Sums over word groups against sums over listed pairs, with shared whashes and first-seen whashes that differ."""
    rng = random.Random(9)
    rows = _rows(160, 21)
    shared = [rows[0][2], rows[1][2], f"{int(rows[0][2], 16) ^ 1:016x}"]
    registry = [(i, p, rng.choice(shared) if rng.random() < 0.5 else w) for i, p, w in rows]
    first = {}
    for i, p, w in registry:
        first.setdefault(p, (i, p, w))
    registry = list(first.values())
    queries = []
    for k in range(120):
        i, p, w = rng.choice(registry)
        kind = rng.random()
        w = w if kind < 0.4 else f"{int(w, 16) ^ (1 << rng.randint(0, 63)):016x}" if kind < 0.6 else rng.choice(shared) if kind < 0.8 else None if kind < 0.9 else f"{rng.getrandbits(64):016x}"
        queries.append((k, i, p, w))
    local = list({(rng.randint(0, 119), rng.choice(registry)[0]) for _ in range(60)})
    qs = spark.createDataFrame(queries, "query_id bigint, registry_id bigint, phash string, whash string")
    rs = spark.createDataFrame([(*r, 0) for r in registry], "image_id bigint, phash string, whash string, s bigint").withColumn("created_at", F.timestamp_seconds("s"))
    ls = spark.createDataFrame(local, "query_id bigint, neighbor_id bigint").withColumn("inliers", F.lit(20))
    ls = ls.join(qs.select("query_id", "registry_id"), "query_id").filter("neighbor_id <> registry_id").drop("registry_id")
    ms = spark.createDataFrame([(i, rng.randint(0, 5), rng.randint(0, 5)) for i, _, _ in registry if rng.random() < 0.7], "image_id bigint, x bigint, y bigint")
    pairs = N.add_distances(N.with_local_matches(N.hash_neighbors(qs, rs), ls), qs, rs).withColumn("has_local", F.col("inliers").isNotNull())
    want = N.sums_from_pairs(qs, pairs, ms, ["x", "y"])
    got = N.neighbor_sums(qs, rs, ms, ["x", "y"], ls)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in want.select(*cols).collect())
    assert a == b and len(a) == 120


def test_counts_by_method_equal_listed_pairs(spark):
    """Half of the registry shares one whash; counts must equal those over listed pairs and must not list them."""
    rng = random.Random(12)
    rows = _rows(120, 8)
    hot = rows[0][2]
    first = {}
    for i, p, w in rows:
        first.setdefault(p, (i, p, hot if i % 2 else w))
    registry = list(first.values())
    queries = [(k, i, p, hot if k % 3 else w) for k, (i, p, w) in enumerate(rng.choice(registry) for _ in range(80))]
    local = [(rng.randint(0, 79), rng.choice(registry)[0]) for _ in range(50)] + [(0, queries[0][1])]
    qs = spark.createDataFrame(queries, "query_id bigint, registry_id bigint, phash string, whash string")
    rs = spark.createDataFrame(registry, "image_id bigint, phash string, whash string").withColumn("created_at", F.current_timestamp())
    ls = spark.createDataFrame(local, "query_id bigint, neighbor_id bigint").distinct().withColumn("inliers", F.lit(20))
    listed = N.add_distances(N.with_local_matches(N.hash_neighbors(qs, rs), ls), qs, rs)
    want = {tuple(r) for r in listed.groupBy("match_method").agg(F.count("*"), F.count_if("is_self_match")).collect()}
    assert {tuple(r) for r in N.method_counts(qs, rs, ls).collect()} == want
    assert listed.count() > 3 * (len(queries) + len(registry) + len(local))

    no_self = ls.join(qs.select("query_id", "registry_id"), "query_id").filter("neighbor_id <> registry_id").drop("registry_id")
    listed = N.add_distances(N.with_local_matches(N.hash_neighbors(qs, rs), no_self), qs, rs)
    n = F.col("neighbor_id")
    own = H.is_self_match(F.when(n % 3 == 0, F.col("is_self_match")), F.when(n % 3 == 1, n), F.col("registry_id"), F.col("neighbor_phash"),
                          F.col("query_phash"), F.when(n % 4 != 2, F.col("neighbor_whash")), F.col("query_whash"))
    want = {tuple(r) for r in listed.groupBy("query_id").agg(F.count_if(~own)).collect()}
    assert {tuple(r) for r in N.distant_counts(qs, rs, no_self, own).collect()} == want
