"""Crop boxes, containment, descriptor matching, the geometric gate and banners."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.functions import boxes as B
from provspark.operators import containment as CT
from provspark.operators import localmatch as LM
from provspark.operators import pixels as PX
from provspark.session import FREE_SHUFFLES

BOX = "a array<double>, b array<double>"


@pytest.mark.parametrize("outer,inner,expect", [
    ([.2, .3, .4, .5], [.5, .5, .5, .5], [.4, .55, .2, .25]),
    ([0., 0., 1., 1.], [.1, .2, .3, .4], [.1, .2, .3, .4]),
    ([0., 0., .5, .5], [0., 0., .5, .5], [0., 0., .25, .25]),
])
def test_compose(one, outer, inner, expect):
    assert one(B.compose, BOX, outer, inner) == pytest.approx(expect)


def test_normalize(one):
    assert one(B.normalize, "a array<double>", [-1., .5, 2., 1.]) == [0., .5, 1., 1.]
    assert one(B.normalize, "a array<double>", [.1, .2, .3]) is None


@pytest.mark.parametrize("raw,ok", [
    (("0.1", "0.1", "0.5", "0.5"), True), (("0.6", "0", "0.5", "0.5"), False), (("nan", "0", "0.5", "0.5"), False),
    (("0", "0", "0", "0.5"), False), (("-0.1", "0", "0.5", "0.5"), False), ((None, "0", "0.5", "0.5"), False), (("x", "0", "1", "1"), False),
])
def test_parse(one, raw, ok):
    got = one(B.parse_strings, "a string, b string, c string, d string", *raw)
    assert (got is not None) is ok


def test_snap_half_even(spark):
    df = spark.createDataFrame([([.25, .0, .5, .5], 402, 400)], "b array<double>, w bigint, h bigint")
    s = B.snap(F.col("b"), F.col("w"), F.col("h"))
    r = df.select(s["left_px"].alias("l"), s["width_px"].alias("w"), s["accepted"].alias("ok")).first()
    assert (r.l, r.w, r.ok) == (100, 201, True)
    tiny = spark.createDataFrame([([.0, .0, .1, .5], 402, 400)], "b array<double>, w bigint, h bigint")
    assert tiny.select(s["accepted"].alias("ok")).first().ok is False


def _replay(events):
    """Sequential walk over save events, each seeing only the links stored before it."""
    stored = []

    def clamp(v):
        return max(0.0, min(1.0, v))

    def save(p, c, box):
        if p != c and (p, c, box) not in stored:
            stored.append((p, c, box))

    for p, c, box in events:
        save(p, c, tuple(round(v, 6) for v in box))
        run, at = list(box), p
        for _ in range(2):
            up = next(((x, b) for x, y, b in stored if y == at), None)
            if up is None:
                break
            o = up[1]
            run = [clamp(o[0] + run[0] * o[2]), clamp(o[1] + run[1] * o[3]), clamp(run[2] * o[2]), clamp(run[3] * o[3])]
            save(up[0], c, tuple(round(v, 6) for v in run))
            at = up[0]
    return set(stored)


def _closure(spark, events, depth=3):
    rows = [(i, p, c, list(b)) for i, (p, c, b) in enumerate(events)]
    df = spark.createDataFrame(rows, "link_id bigint, parent_id bigint, child_id bigint, box array<double>")
    return {(r.parent_id, r.child_id, tuple(r.box)) for r in CT.containment_closure(df, depth).collect()}


def test_closure_half_of_half(spark):
    half = (0., 0., .5, .5)
    got = _closure(spark, [(1, 2, half), (2, 3, half)])
    assert (1, 3, (0., 0., .25, .25)) in got and len(got) == 3
    chain = _closure(spark, [(i, i + 1, half) for i in range(1, 6)])
    assert {(p, c) for p, c, _ in chain if c == 6} == {(5, 6), (4, 6), (3, 6)}
    assert _closure(spark, [(2, 3, half), (1, 2, half)]) == {(2, 3, half), (1, 2, half)}
    assert _closure(spark, [(1, 2, half)] * 3) == {(1, 2, half)}


@pytest.mark.parametrize("seed", range(3))
def test_closure_equals_sequential_walk(spark, seed):
    rng = random.Random(seed)
    events = []
    for _ in range(60):
        p, c = sorted(rng.sample(range(14), 2))
        events.append((p, c, tuple(rng.choice([0., .25, .5]) for _ in range(2)) + (.5, .25)))
    assert _closure(spark, events) == _replay(events)


def test_visible(table):
    links = table("link_id bigint, parent_id bigint, child_id bigint, box array<double>",
                  (1, 1, 2, [0., 0., 1., 1.]), (2, 1, 3, [0., 0., 1., 1.]), (3, 1, 4, None), (4, 1, 5, [0., 0., 1., 1.]))
    votes = table("image_id bigint, vote_real bigint, vote_edited bigint, vote_ai bigint", (2, 1, 0, 0), (4, 1, 0, 0), (5, 0, 0, 0))
    facts = table("image_id bigint, analyzer string, data string", (3, "c2pa", "x"))
    got = {(r.child_id, r.vote_real, r.fact_count) for r in CT.containment_visible(links, votes, facts).collect()}
    assert got == {(2, 1, 0), (3, 0, 1)}


def _brute_matches(q, c):
    best = {}
    for qi, qd in q:
        ds = sorted((sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(qd, cd)), ci) for ci, cd in c)
        if len(ds) >= 2 and ds[0][0] < 0.72 * ds[1][0]:
            d, t = ds[0]
            if t not in best or (d, qi) < best[t]:
                best[t] = (d, qi)
    return {(qi, t, d) for t, (d, qi) in best.items()}


def test_descriptor_match(spark, monkeypatch):
    monkeypatch.setattr(LM, "BLOCK", 7)
    rng = random.Random(3)
    def word():
        return rng.getrandbits(64) - 2**63

    q = [(i, [word() for _ in range(4)]) for i in range(30)]
    c = [(i, list(q[i % 20][1])) for i in range(25)] + [(25 + i, [word() for _ in range(4)]) for i in range(10)]
    for _, d in c:
        for _ in range(rng.randint(0, 20)):
            k = rng.randint(0, 3)
            d[k] = (d[k] ^ (1 << rng.randint(0, 62)))
    rows = [(1, i, *d) for i, d in q] + [(2, i, *d) for i, d in c] + [(3, 0, *q[0][1])]
    kp = spark.createDataFrame(rows, "image_id bigint, kp_idx bigint, d0 bigint, d1 bigint, d2 bigint, d3 bigint")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "query_id bigint, candidate_id bigint")
    got = LM.descriptor_match(pairs, kp).collect()
    assert {(r.query_idx, r.train_idx, r.distance) for r in got if r.candidate_id == 2} == _brute_matches(q, c)
    assert not [r for r in got if r.candidate_id == 3]  # one descriptor has no second neighbor


FEAT = "image_id bigint, extractor string, width bigint, height bigint, keypoint_count bigint"


def _gate(spark, table, n_in, n_out, span=80, keypoints=40, h=(1., 0., 0., 0., 1., 0., 0., 0., 1.), extractor="orb"):
    rows = []
    for i in range(n_in + n_out):
        x = float(i * span / max(1, n_in - 1)) if i < n_in else 5.0
        rows.append((1, 2, x, x, x, x, i < n_in))
    corr = spark.createDataFrame(rows, "query_id bigint, candidate_id bigint, qx double, qy double, cx double, cy double, is_inlier boolean")
    pairs = table("query_id bigint, candidate_id bigint, h array<double>", (1, 2, list(h) if h else None))
    feats = table(FEAT, (1, "orb", 100, 100, keypoints), (2, extractor, 100, 100, keypoints))
    return LM.pair_geometry_gate(pairs, corr, feats).first()


def test_gate_reasons(spark, table):
    ok = _gate(spark, table, 20, 5)
    assert (ok.passed, ok.reason, ok.inliers, ok.good_matches) == (True, "ok", 20, 25)
    assert ok.query_coverage > 0.6 and ok.box == [0., 0., 1., 1.]
    assert _gate(spark, table, 20, 3).reason == "too_few_good_matches"
    assert _gate(spark, table, 15, 10).reason == "insufficient_inliers"
    assert _gate(spark, table, 16, 24).reason == "insufficient_inlier_ratio"
    assert _gate(spark, table, 20, 5, keypoints=500).reason == "insufficient_keypoint_support"
    small = _gate(spark, table, 20, 5, span=1)
    assert small.reason == "insufficient_inlier_spread" and small.query_coverage < 0.001
    assert _gate(spark, table, 20, 5, h=None).reason == "homography_not_found"
    assert _gate(spark, table, 20, 5, h=(1., 0., 500., 0., 1., 0., 0., 0., 1.)).reason == "invalid_projected_box"
    assert _gate(spark, table, 20, 5, extractor="akaze").reason == "extractor_mismatch"


def test_feature_select(table):
    f = table("image_id bigint, extractor string, feature_version int, width int, height int, keypoint_count int",
              (1, "orb", 1, 9, 9, 140), (1, "akaze", 1, 9, 9, 900), (2, "orb", 1, 9, 9, 100), (2, "akaze", 1, 9, 9, 100),
              (3, "orb", 1, 9, 9, 100), (3, "akaze", 1, 9, 9, 99), (4, "akaze", 1, 9, 9, 3), (5, "orb", 2, 9, 9, 999), (6, "sift", 1, 9, 9, 9), (7, "orb", 1, 0, 9, 9))
    got = {(r.image_id, r.extractor) for r in LM.feature_select(LM.feature_valid(f)).collect()}
    assert got == {(1, "orb"), (2, "akaze"), (3, "orb"), (4, "akaze")}
    plain = {(r.image_id, r.extractor) for r in LM.feature_select(LM.feature_valid(f), akaze_fallback=False).collect()}
    assert plain == {(1, "orb"), (2, "orb"), (3, "orb")}


def test_local_candidates(table):
    q = table("query_id bigint, registry_id bigint", (1, 10), (2, 11))
    kp = table("image_id bigint, kp_idx int, d0 bigint, d1 bigint, d2 bigint, d3 bigint", (10, 0, 1 << 40, 2, 3, 4), (10, 1, 9, 9, 9, 9), (11, 0, 1 << 40, 2, 3, 5),
               (12, 0, 77 << 32, 88, 3, 99), (13, 0, -1, -2, -3, -4), (14, 0, 9, 9, 9, 9))
    f = table("image_id bigint", *[(i,) for i in (10, 11, 12, 13)])
    got = {(r.query_id, r.candidate_id): (r.shared, r.candidate_rank) for r in LM.local_candidates(q, kp, f).collect()}
    assert got[(1, 11)] == (7, 1) and (1, 13) not in got and (1, 10) not in got and (1, 14) not in got
    assert {k[1] for k in got if k[0] == 2} == {10, 12}
    assert {(r.query_id, r.candidate_id) for r in LM.local_candidates(q, kp, f, budget=1).collect()} == {(1, 11), (2, 10)}
    assert LM.local_candidates(q, kp, f, enabled=False).count() == 0


def _image(bottom=0, top=0, left=0, right=400):
    img = np.full((300, 400), 150, dtype=np.int64)
    if bottom:
        img[300 - bottom:, left:right] = 20
        if left == 0:
            for x in range(10, 390, 30):
                img[300 - bottom + 5:295, x:x + 20] = 240
    if top:
        img[:top] = 20
        for x in range(10, 390, 30):
            img[5:top - 5, x:x + 20] = 240
    return img


def test_banners(spark):
    noise = np.random.default_rng(0).integers(0, 256, (300, 300))
    images = {1: _image(bottom=60), 2: _image(top=50), 3: _image(bottom=60, top=50), 4: _image(), 5: _image(bottom=120),
              6: _image(bottom=60, left=100, right=300), 7: noise, 8: _image(bottom=60)[-30:]}
    rows = [(i, y, [int(v) for v in line]) for i, img in images.items() for y, line in enumerate(img)]
    df = spark.createDataFrame(rows, "image_id bigint, y bigint, px array<int>")
    got = {r.image_id: r for r in PX.banner_rows(df).collect()}
    assert [i for i in sorted(got) if got[i].has_overlay] == [1, 2, 3]
    assert got[1].method == "Detected: bottom text banner" and got[1].crop_box[3] == pytest.approx(0.8, abs=0.02)
    assert got[2].method == "Detected: top text banner" and got[2].crop_box[1] == pytest.approx(50 / 300, abs=0.02)
    assert got[3].method == "Detected: top text banner and bottom text banner"


def test_crop_quality(table):
    rows = [(1, 100)] * 50 + [(2, v) for v in range(256)] + [(3, 90), (3, 110)]
    got = {r.crop_id: r for r in PX.crop_quality(table("crop_id bigint, value bigint", *rows)).collect()}
    assert (got[1].entropy, got[1].contrast, got[1].accepted) == (0.0, 0.0, False)
    assert got[2].entropy == pytest.approx(8.0) and got[2].accepted
    assert got[3].entropy == pytest.approx(1.0) and got[3].contrast == pytest.approx(10.0)


def test_closure_goes_to_the_root_and_ends_on_cycles(spark):
    half = (0., 0., .5, .5)
    chain = _closure(spark, [(i, i + 1, half) for i in range(1, 7)], None)
    assert {(p, c) for p, c, _ in chain if c == 7} == {(p, 7) for p in range(1, 7)}
    ring = _closure(spark, [(2, 1, half), (1, 2, half), (1, 3, half)], None)
    assert {(p, c) for p, c, _ in ring} == {(2, 1), (1, 2), (1, 3), (2, 3)}


@pytest.mark.parametrize("seed", range(4))
def test_closure_by_jumps_equals_walks(spark, seed):
    """Chains, trees, walks that come back to their child, and cycles."""
    rng = random.Random(seed)
    n = (14, 40, 200, 12)[seed]
    rows = []
    for i in range(3 * n):
        p, c = rng.sample(range(n), 2)
        if seed != 3 and rng.random() < 0.9:
            p, c = sorted((p, c))
        if seed == 2:
            p, c = max(0, c - rng.randint(1, 2)), c
        rows.append((i, p, c, [rng.choice([0., .1, .25, .4]), rng.choice([0., .3, .5]), rng.choice([.5, .75, .9]), rng.choice([1., .6])]))
    stored, want = {}, {}
    for link, p, c, box in rows:
        at, b, seen, depth = p, box, [c, p], 1
        while True:
            if at != c:
                want.setdefault((at, c), []).append((depth, b))
            up = stored.get(at)
            if up is None or up[0] in seen:
                break
            o = [round(v, 6) for v in up[1]]
            b = [min(1., o[0] + b[0] * o[2]), min(1., o[1] + b[1] * o[3]), b[2] * o[2], b[3] * o[3]]
            at = up[0]
            seen.append(at)
            depth += 1
        if p != c:
            stored.setdefault(c, (p, box))
    got = {}
    for r in CT.containment_closure(spark.createDataFrame(rows, "link_id bigint, parent_id bigint, child_id bigint, box array<double>")).collect():
        got.setdefault((r.parent_id, r.child_id), []).append((r.depth, r.box))
    assert got.keys() == want.keys()
    for key, boxes in want.items():
        near = lambda a, b: all(abs(x - y) < 2e-6 for x, y in zip(a, b))
        assert all(any(near(a, b) for _, b in got[key]) for _, a in boxes) and all(any(near(a, b) for _, b in boxes) for _, a in got[key])
        assert min(d for d, _ in boxes) == min(d for d, _ in got[key])


def test_closure_of_a_long_chain(spark):
    n = 10_000
    # The chain is saved from its upper end; only its lowest link is saved again, after all others, and walks to the root.
    rows = spark.range(1, n + 1).selectExpr("id as link_id", "id - 1 as parent_id", "id as child_id", "array(0.0D, 0.5D, 1.0D, 1.0D) as box")
    first, circling = CT._jumps(CT.cut_lineage(spark, rows.selectExpr("child_id as a_child", "link_id as a_link", "parent_id as a_parent", "box as a_box"), "first"))
    assert circling is None and len(first) == 14
    walks = spark.createDataFrame([(n + 1, n + 1, n, [0.25, 0.25, 0.5, 0.5], 1)], "link_id bigint, child_id bigint, at bigint, box array<double>, depth int")
    for i in reversed(range(len(first))):
        walks = CT._jumped(walks, first[i], 2 ** i)
    got = {r.at: (r.depth, r.box) for r in walks.collect()}
    assert got == {at: (n + 1 - at, [0.25, 0.25 if at == n else 0.75 if at == n - 1 else 1.0, 0.5, 0.5]) for at in range(n + 1)}


# Local matching in one flow ------------------------------------------------------------------------------------------

def _views(rng, image, other, flips, matches, width, height):
    """Keypoints of an image and of a view of it, scaled and shifted: ``matches`` descriptors differ in ``flips`` bits, the rest are new."""
    words = rng.integers(-2**63, 2**63 - 1, (64, 4), dtype=np.int64)
    seen = rng.integers(-2**63, 2**63 - 1, (64, 4), dtype=np.int64)
    points = rng.random((64, 2)) * [width, height]
    moved = rng.random((64, 2)) * [width, height]
    for k in range(matches):
        bits = np.unpackbits(words[k].view(np.uint8))
        bits[rng.choice(256, flips, replace=False)] ^= 1
        seen[k] = np.packbits(bits).view(np.int64)
        moved[k] = points[k] * 0.8 + [20, 10]
    rows = [(image, k, *map(int, words[k]), *map(float, points[k])) for k in range(64)]
    return rows + [(other, k, *map(int, seen[k]), *map(float, moved[k])) for k in range(64)]


KEYPOINTS = "image_id bigint, kp_idx bigint, d0 bigint, d1 bigint, d2 bigint, d3 bigint, x double, y double"


@pytest.mark.parametrize("flips", [30, 50])
def test_candidates_by_probing_reach_most_true_pairs(spark, flips):
    rng = np.random.default_rng(flips)
    rows = [r for i in range(100) for r in _views(rng, 2 * i, 2 * i + 1, flips, 24, 640, 480)]
    # Descriptors that very many images share, one of them all zero, are no reason to miss or to add a pair.
    rows += [(i, 64 + j, *[0 if j else 5] * 4, 1.0, 1.0) for i in range(0, 200, 2) for j in range(3)]
    keypoints = spark.createDataFrame(rows, KEYPOINTS).repartition(8)
    queries = spark.createDataFrame([(2 * i, 2 * i) for i in range(100)], "query_id bigint, registry_id bigint")
    usable = spark.createDataFrame([(2 * i + 1,) for i in range(100)], "image_id bigint")
    got = {(r.query_id, r.candidate_id) for r in LM.probed_candidates(queries, keypoints, usable).collect()}
    true = {(2 * i, 2 * i + 1) for i in range(100)}
    assert len(got & true) >= (100 if flips == 30 else 92)
    assert len(got - true) <= 20


def test_probed_candidates_equal_probing_with_every_flip(spark):
    """Shared bits counted one by one, also of repeated and of nearly equal descriptors; few rows of keys for a descriptor."""
    rng = np.random.default_rng(11)
    rows = []
    base = rng.integers(0, 256, (12, 32), dtype=np.uint8)
    for image in range(14):
        for k in range(10):
            bits = np.unpackbits(base[rng.integers(12)])
            bits[rng.choice(256, int(rng.integers(0, 70)), replace=False)] ^= 1
            d = np.packbits(bits).view(np.int64).tolist()
            rows += [(image, 2 * k, *d), (image, 2 * k + 1, *d)] if k < 2 else [(image, 2 * k, *d)]
    rows.append((3, 99, None, 1, 2, 3))
    keypoints = spark.createDataFrame(rows, "image_id bigint, kp_idx bigint, d0 bigint, d1 bigint, d2 bigint, d3 bigint")
    queries = spark.createDataFrame([(i, 5 if i == 7 else i) for i in range(0, 14)], "query_id bigint, registry_id bigint")
    usable = spark.createDataFrame([(i,) for i in range(2, 14)], "image_id bigint")
    draws = np.random.default_rng(7)
    places = [np.sort(draws.choice(256, LM.KEY_BITS, replace=False)) for _ in range(LM.TABLES)]
    keys = {}
    for image, _, *d in rows:
        if d[0] is not None:
            on = np.unpackbits(np.array(d, np.int64).view(np.uint8))
            keys.setdefault(image, set()).update((t, tuple(on[p].tolist())) for t, p in enumerate(places))
    want = {}
    for q in range(14):
        for c in range(2, 14):
            n = sum(any(t == u and sum(x != y for x, y in zip(a, b)) <= 1 for u, a in keys[q]) for t, b in keys[c])
            if c not in (q, 5 if q == 7 else q) and n >= LM.MIN_SHARED:
                want[q, c] = n
    got = {(r.query_id, r.candidate_id): r.shared for r in LM.probed_candidates(queries, keypoints, usable).collect()}
    assert got == want and len(want) > 20
    made = []
    whole, LM._sampled_keys = LM._sampled_keys, lambda *a: made.append(whole(*a)) or made[-1]
    try:
        LM.probed_candidates(queries, keypoints, usable)
    finally:
        LM._sampled_keys = whole
    assert sum(m.count() for m in made) <= 400 * len(rows)


def test_local_matches_from_descriptors_to_verdict(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i, (flips, matches) in enumerate([(20, 60), (30, 40), (40, 50), (20, 20), (30, 10), (0, 64)]):
        rows += _views(rng, 2 * i, 2 * i + 1, flips, matches, 640, 480)
    keypoints = spark.createDataFrame(rows + [(0, 70, None, 1, 1, 1, 5.0, 5.0)], KEYPOINTS)
    features = spark.createDataFrame([(i, "akaze" if i == 11 else "orb", 640, 480, 64) for i in range(12)], "image_id bigint, extractor string, width int, height int, keypoint_count bigint")
    queries = spark.createDataFrame([(i, i) for i in range(12)], "query_id bigint, registry_id bigint")
    registry = spark.createDataFrame([(i,) for i in range(12) if i != 2], "image_id bigint")
    got = {(r.query_id, r.neighbor_id): r for r in LM.local_matches(queries, keypoints, features, registry).collect()}
    # Image 2 is not registered, pair 6/7 has too few matches, 10/11 differ in the extractor.
    assert set(got) == {(0, 1), (1, 0), (2, 3), (4, 5), (5, 4)}
    r = got[0, 1]
    assert r.homography_found and r.inliers >= 58 and r.good_matches >= r.inliers and r.inlier_ratio == round(r.inliers / r.good_matches, 4)
    assert r.box == pytest.approx([20 / 640, 10 / 480, 0.8, 0.8], abs=0.01)
    assert not LM.local_matches(queries, keypoints, features.limit(0), registry).count()


def test_homography_is_the_planted_one_and_the_same_each_time(spark):
    rng = np.random.default_rng(8)
    h = np.array([[0.9, 0.1, 12.0], [-0.05, 1.1, 4.0], [1e-4, 2e-4, 1.0]])
    q = rng.random((80, 2)) * 500
    to = np.c_[q, np.ones(80)] @ h.T
    c = to[:, :2] / to[:, 2:]
    c[50:] = rng.random((30, 2)) * 500
    rows = [(1, 2, *map(float, q[k]), *map(float, c[k])) for k in range(80)] + [(3, 4, float(k), float(k), 1.0, 1.0) for k in range(40)] + [(5, 6, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "query_id bigint, candidate_id bigint, qx double, qy double, cx double, cy double")
    got = LM.homographies(df).collect()
    fits = {tuple(r.h) for r in got if r.query_id == 1}
    assert len(fits) == 1 and np.allclose(np.array(fits.pop()).reshape(3, 3), h, rtol=1e-3, atol=1e-3)
    assert sum(r.is_inlier for r in got if r.query_id == 1) in range(50, 54)
    assert all(r.h is None and not r.is_inlier for r in got if r.query_id == 5)
    again = {(r.qx, r.is_inlier) for r in LM.homographies(df.repartition(5)).collect() if r.query_id == 1}
    assert again == {(r.qx, r.is_inlier) for r in got if r.query_id == 1}


def test_probed_candidates_in_rounds_are_the_same_and_leave_no_shuffles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [r for i in range(12) for r in _views(rng, 2 * i, 2 * i + 1, 30, 24, 640, 480)]
    rows += [(i, 64 + j, *[7] * 4, 1.0, 1.0) for i in range(0, 24, 3) for j in range(3)]
    keypoints = spark.createDataFrame(rows, KEYPOINTS).repartition(3)
    queries = spark.createDataFrame([(i, i) for i in range(24)], "query_id bigint, registry_id bigint")
    usable = spark.createDataFrame([(i,) for i in range(24)], "image_id bigint")
    whole = sorted(LM.probed_candidates(queries, keypoints, usable).collect())
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.split("/")[-1] for f in disk.getAllFiles().mkString("\n").split("\n") if f.endswith(".data") and "shuffle_" in f}
    before = files()
    monkeypatch.setattr(LM, "PART", 2000)
    few = LM.probed_candidates(queries, keypoints, usable, at_once=2 * len(rows) * 10)  # ten of the tables at a time
    until = time.monotonic() + 20  # Spark deletes in the background
    while files() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert files() <= before
    assert sorted(few.collect()) == whole and len(whole) >= 24
    assert spark.conf.get(FREE_SHUFFLES, None) is None


def test_sampled_keys_are_packed(spark):
    """Two keys of 14 bytes for each table and descriptor, many to a row, each in the part of its half."""
    rng = np.random.default_rng(6)
    rows = [(i % 7, *map(int, rng.integers(-2**63, 2**63 - 1, 4, dtype=np.int64)), 3) for i in range(500)] + [(1, None, 1, 1, 1, 3)]
    keypoints = spark.createDataFrame(rows, "image_id bigint, d0 bigint, d1 bigint, d2 bigint, d3 bigint, side int").repartition(2)
    packed = LM._sampled_keys(keypoints, range(5, 9), 3).collect()
    assert len(packed) == 2 * 3 and sum(len(r.packed) for r in packed) == 14 * 2 * 4 * 500
    parts = {}
    for r in packed:
        a = np.frombuffer(r.packed, np.uint8).reshape(14, -1)
        value = np.ascontiguousarray(a[2:6].T).view("<u4")[:, 0]
        for code, v, image in zip(a[0].tolist(), value.tolist(), np.ascontiguousarray(a[6:].T).view("<i8")[:, 0].tolist()):
            assert code // 2 in range(5, 9) and image in range(7)
            parts.setdefault((code, v & 0xFFFF if code % 2 else v >> 16), set()).add(r.part)
    assert all(len(p) == 1 for p in parts.values()) and {p for x in parts.values() for p in x} == {0, 1, 2}
