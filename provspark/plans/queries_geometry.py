"""Registered queries: crop boxes, containment, local matching, pixel analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from provspark.functions import boxes as B
from provspark.functions import hashing as H
from provspark.operators import consensus as C
from provspark.operators import containment as CT
from provspark.operators import localmatch as LM
from provspark.operators import neighbors as N
from provspark.operators import pixels as PX
from provspark.plans.catalog import query
from provspark.plans.queries_community import FACTS, VOTES, facts_of, votes_of
from provspark.plans.queries_matching import HASH_PAIRS, queries_of


def _links(ev):
    return ev.link_event.select("link_id", "parent_id", "child_id", F.array("l", "t", "w", "h").alias("box"))


def _four(box, names="left top width height", digits=6):
    return [F.round(F.col(box)[i], digits).alias(n) for i, n in enumerate(names.split())]


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


# Crop boxes ----------------------------------------------------------------------------------------------------------

@query("crop_box_normalize", "fx_link_event", f"""
    SELECT link_id, round({_clamp('l - 0.1')}, 6) AS left, round({_clamp('t')}, 6) AS top, round({_clamp('w + 0.7')}, 6) AS width, round({_clamp('h / 3')}, 6) AS height
    FROM fx_link_event WHERE link_id % 5 <> 0
    UNION ALL SELECT link_id, NULL, NULL, NULL, NULL FROM fx_link_event WHERE link_id % 5 = 0
""")
def crop_box_normalize(ev):
    full = F.array(F.col("l") - 0.1, F.col("t"), F.col("w") + 0.7, F.col("h") / 3)
    box = F.when(F.col("link_id") % 5 == 0, F.slice(full, 1, 3)).otherwise(full)
    return ev.link_event.select("link_id", B.rounded(B.normalize(box)).alias("b")).select("link_id", *_four("b"))


@query("crop_box_compose", "fx_link_event", f"""
    SELECT link_id, round({_clamp('l + t * w')}, 6) AS left, round({_clamp('t + l * h')}, 6) AS top, round({_clamp('h * w')}, 6) AS width, round({_clamp('w * h')}, 6) AS height
    FROM fx_link_event
""")
def crop_box_compose(ev):
    outer, inner = F.array("l", "t", "w", "h"), F.array("t", "l", "h", "w")
    return ev.link_event.select("link_id", B.compose(outer, inner).alias("b")).select("link_id", *_four("b"))


@query("crop_box_validate", "fx_link_event", """
    SELECT link_id, CASE WHEN ok THEN a END AS left, CASE WHEN ok THEN b END AS top, CASE WHEN ok THEN c END AS width, CASE WHEN ok THEN d END AS height,
           CASE WHEN link_id % 4 <> 0 AND parent_id > 0 THEN parent_id END AS parent_id
    FROM (SELECT *, coalesce(isfinite(a) AND isfinite(d) AND a >= 0 AND a <= 1 AND b >= 0 AND b <= 1 AND c > 0 AND c <= 1 AND d > 0 AND d <= 1 AND a + c <= 1 AND b + d <= 1, false) AS ok
          FROM (SELECT link_id, parent_id, CASE link_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE ELSE l * 2 END AS a, t AS b, w AS c, h * 2 AS d FROM fx_link_event))
""")
def crop_box_validate(ev):
    m = F.col("link_id") % 6
    left = F.when(m == 0, "left").when(m == 1, "nan").otherwise((F.col("l") * 2).cast("string"))
    parent = F.when(F.col("link_id") % 4 == 0, F.concat(F.col("parent_id").cast("string"), F.lit("x"))).otherwise(
        F.col("parent_id").cast("string")
    )
    box = B.parse_strings(left, F.col("t").cast("string"), F.col("w").cast("string"), (F.col("h") * 2).cast("string"))
    rows = ev.link_event.select("link_id", box.alias("b"), B.parse_parent_id(parent).alias("parent_id"))
    return rows.select(
        "link_id", *[F.col("b")[i].alias(n) for i, n in enumerate("left top width height".split())], "parent_id"
    )


@query("crop_box_snap", "fx_link_event", """
    SELECT link_id, lp AS left_px, tp AS top_px, wp AS width_px, hp AS height_px, wp >= 150 AND hp >= 150 AS accepted,
           CASE WHEN wp >= 150 AND hp >= 150 THEN round(wp::DOUBLE / iw, 6) END AS width_share
    FROM (SELECT *, greatest(1, least(CAST(round_even(w * iw, 0) AS BIGINT), iw - lp)) AS wp, greatest(1, least(CAST(round_even(h * ih, 0) AS BIGINT), ih - tp)) AS hp
          FROM (SELECT *, greatest(0, least(CAST(round_even(l * iw, 0) AS BIGINT), iw - 1)) AS lp, greatest(0, least(CAST(round_even(t * ih, 0) AS BIGINT), ih - 1)) AS tp
                FROM (SELECT *, 100 + link_id % 431 AS iw, 205 + link_id % 603 AS ih FROM fx_link_event)))
""")
def crop_box_snap(ev):
    iw, ih = F.lit(100) + F.col("link_id") % 431, F.lit(205) + F.col("link_id") % 603
    s = B.snap(F.array("l", "t", "w", "h"), iw, ih)
    return ev.link_event.select(
        "link_id", *[s[c].cast("bigint").alias(c) for c in ("left_px", "top_px", "width_px", "height_px")],
        s["accepted"].alias("accepted"), F.round(s["box"][2], 6).alias("width_share"),
    )


@query("crop_box_struct", "fx_link_event", """
    SELECT link_id, CASE WHEN link_id % 3 <> 0 THEN l END AS left, CASE WHEN link_id % 3 <> 0 THEN t END AS top,
           CASE WHEN link_id % 3 <> 0 THEN w END AS width, CASE WHEN link_id % 3 <> 0 THEN h END AS height FROM fx_link_event
""")
def crop_box_struct(ev):
    m = F.col("link_id") % 6
    box = F.when(m == 0, F.array("l", "t")).when(m == 3, F.array("l", "t", F.lit(None).cast("double"), "h")).otherwise(
        F.array("l", "t", "w", "h")
    )
    return ev.link_event.select("link_id", B.as_struct(box).alias("b")).select(
        "link_id", "b.left", "b.top", "b.width", "b.height"
    )


# Containment ---------------------------------------------------------------------------------------------------------

# Boxes are rounded as decimals: a half at the seventh place goes up, whatever its binary form.
CLOSURE = f"""
direct AS (SELECT link_id, parent_id, child_id, {_clamp('l')} AS l, {_clamp('t')} AS t, {_clamp('w')} AS w, {_clamp('h')} AS h FROM fx_link_event),
first_parent AS (SELECT * EXCLUDE (rn) FROM (SELECT child_id AS c, link_id AS a_link, parent_id AS a_parent, CAST(round(CAST(CAST(l AS VARCHAR) AS DECIMAL(38, 22)), 6) AS DOUBLE) AS al, CAST(round(CAST(CAST(t AS VARCHAR) AS DECIMAL(38, 22)), 6) AS DOUBLE) AS at_, CAST(round(CAST(CAST(w AS VARCHAR) AS DECIMAL(38, 22)), 6) AS DOUBLE) AS aw, CAST(round(CAST(CAST(h AS VARCHAR) AS DECIMAL(38, 22)), 6) AS DOUBLE) AS ah,
                 row_number() OVER (PARTITION BY child_id ORDER BY link_id) AS rn FROM direct WHERE parent_id <> child_id) WHERE rn = 1),
walk AS (
  SELECT link_id, child_id, parent_id AS cur, l, t, w, h, 1 AS depth, [child_id, parent_id] AS seen FROM direct
  UNION ALL
  SELECT k.link_id, k.child_id, a.a_parent, {_clamp('a.al + k.l * a.aw')}, {_clamp('a.at_ + k.t * a.ah')}, {_clamp('k.w * a.aw')}, {_clamp('k.h * a.ah')}, k.depth + 1, list_append(k.seen, a.a_parent)
  FROM walk k JOIN first_parent a ON k.cur = a.c AND a.a_link < k.link_id WHERE NOT list_contains(k.seen, a.a_parent))
"""


@query("containment_closure", "fx_link_event", "WITH RECURSIVE " + CLOSURE + """
    SELECT parent_id, child_id, "left", top, width, height, CAST(min(depth) AS BIGINT) AS depth FROM (
      SELECT cur AS parent_id, child_id, CAST(round(CAST(CAST(l + 1e-10 AS VARCHAR) AS DECIMAL(38, 22)), 6) AS DOUBLE) AS "left", CAST(round(CAST(CAST(t + 1e-10 AS VARCHAR) AS DECIMAL(38, 22)), 6) AS DOUBLE) AS top, CAST(round(CAST(CAST(w + 1e-10 AS VARCHAR) AS DECIMAL(38, 22)), 6) AS DOUBLE) AS width, CAST(round(CAST(CAST(h + 1e-10 AS VARCHAR) AS DECIMAL(38, 22)), 6) AS DOUBLE) AS height, depth FROM walk WHERE cur <> child_id)
    GROUP BY ALL
""")
def containment_closure(ev):
    out = CT.containment_closure(_links(ev))
    return out.select("parent_id", "child_id", *_four("box"), F.col("depth").cast("bigint").alias("depth"))


@query("containment_visible", "fx_link_event fx_vote_event fx_registry fx_fact", "WITH " + VOTES + "," + FACTS + """,
    f AS (SELECT image_id, count(*) AS n FROM facts GROUP BY image_id)
    SELECT link_id, parent_id, child_id, coalesce(vote_real, 0) AS vote_real, coalesce(vote_edited, 0) AS vote_edited, coalesce(vote_ai, 0) AS vote_ai, coalesce(n, 0) AS fact_count
    FROM fx_link_event l LEFT JOIN votes v ON v.image_id = l.child_id LEFT JOIN f ON f.image_id = l.child_id
    WHERE link_id % 9 <> 4 AND (coalesce(vote_real + vote_edited + vote_ai, 0) > 0 OR coalesce(n, 0) > 0)
""")
def containment_visible(ev):
    # Stored boxes are JSON text; one that does not parse hides its link.
    text = F.when(F.col("link_id") % 9 == 4, "{broken").otherwise(F.to_json("box"))
    links = _links(ev).withColumn("box", F.from_json(text, "array<double>"))
    links = links.withColumn("box", F.when(text.startswith("["), F.col("box")))
    return CT.containment_visible(links, votes_of(ev), facts_of(ev)).select(
        "link_id", "parent_id", "child_id", "vote_real", "vote_edited", "vote_ai", "fact_count"
    )


# Local matching ------------------------------------------------------------------------------------------------------

def keypoints_of(ev):
    words = [H.decode_hash(F.col(d)).alias(d) for d in ("d0", "d1", "d2", "d3")]
    return ev.keypoint.select("image_id", "kp_idx", *words, "x", "y")


def pairs_of(ev):
    """Image pairs to compare: each even image against the odd image after it."""
    even = ev.image_features.filter("image_id % 2 = 0").select(F.col("image_id").alias("query_id"))
    return even.withColumn("candidate_id", F.col("query_id") + 1)


_KD = " + ".join(f"CAST(bit_count(xor(('0x' || a.{d})::UBIGINT, ('0x' || b.{d})::UBIGINT)) AS INT)" for d in ("d0", "d1", "d2", "d3"))

MATCHED = f"""
dists AS (SELECT a.image_id AS query_id, b.image_id AS candidate_id, a.kp_idx AS query_idx, b.kp_idx AS train_idx, {_KD} AS dist
          FROM fx_keypoint a JOIN fx_keypoint b ON a.image_id % 2 = 0 AND b.image_id = a.image_id + 1),
two AS (SELECT *, row_number() OVER (PARTITION BY query_id, query_idx ORDER BY dist, train_idx) AS rn,
               lead(dist) OVER (PARTITION BY query_id, query_idx ORDER BY dist, train_idx) AS d2 FROM dists),
good AS (SELECT *, row_number() OVER (PARTITION BY query_id, train_idx ORDER BY dist, query_idx) AS k FROM two WHERE rn = 1 AND dist < 0.72 * d2),
matched AS MATERIALIZED (SELECT query_id, candidate_id, query_idx, train_idx, CAST(dist AS BIGINT) AS distance FROM good WHERE k = 1)
"""


@query("descriptor_match", "fx_keypoint", "WITH " + MATCHED + "SELECT * FROM matched")
def descriptor_match(ev):
    return LM.descriptor_match(pairs_of(ev), keypoints_of(ev))


@query("pair_geometry_gate", "fx_keypoint fx_image_features", "WITH " + MATCHED + f""",
    corr AS (SELECT m.*, a.x AS qx, a.y AS qy, b.x AS cx, b.y AS cy, (m.query_idx * 7 + m.query_id) % 5 <> 0 AND m.query_id % 8 <> 6 AS inl
             FROM matched m JOIN fx_keypoint a ON a.image_id = m.query_id AND a.kp_idx = m.query_idx
             JOIN fx_keypoint b ON b.image_id = m.candidate_id AND b.kp_idx = m.train_idx),
    sums AS (SELECT query_id, count(*) AS g, count(CASE WHEN inl THEN 1 END) AS i, max(qx) FILTER (inl) - min(qx) FILTER (inl) AS sqx, max(qy) FILTER (inl) - min(qy) FILTER (inl) AS sqy,
                    max(cx) FILTER (inl) - min(cx) FILTER (inl) AS scx, max(cy) FILTER (inl) - min(cy) FILTER (inl) AS scy FROM corr GROUP BY query_id),
    j AS (SELECT q.image_id AS query_id, c.image_id AS candidate_id, coalesce(g, 0) AS g, coalesce(i, 0) AS i,
                 CASE WHEN q.width > 0 AND q.height > 0 AND i >= 2 THEN {_clamp('sqx / q.width')} * {_clamp('sqy / q.height')} ELSE 0.0 END AS qc,
                 CASE WHEN c.width > 0 AND c.height > 0 AND i >= 2 THEN {_clamp('scx / c.width')} * {_clamp('scy / c.height')} ELSE 0.0 END AS cc,
                 coalesce(i, 0)::DOUBLE / least(q.keypoint_count, c.keypoint_count) AS support,
                 CASE WHEN coalesce(g, 0) > 0 THEN i::DOUBLE / g ELSE 0.0 END AS ratio, q.image_id % 10 = 4 AS no_h, c.width > 0 AND c.height > 0 AS usable
          FROM fx_image_features q JOIN fx_image_features c ON q.image_id % 2 = 0 AND c.image_id = q.image_id + 1 LEFT JOIN sums s ON s.query_id = q.image_id),
    r AS (SELECT *, CASE WHEN g < 24 THEN 'too_few_good_matches' WHEN no_h THEN 'homography_not_found' WHEN i < 16 THEN 'insufficient_inliers' WHEN ratio < 0.45 THEN 'insufficient_inlier_ratio'
                 WHEN support < 0.10 THEN 'insufficient_keypoint_support' WHEN greatest(qc, cc) < 0.12 THEN 'insufficient_inlier_spread'
                 WHEN least(qc, cc) < 0.01 THEN 'insufficient_secondary_inlier_spread' WHEN NOT usable THEN 'invalid_projected_box' ELSE 'ok' END AS reason FROM j)
    SELECT query_id, candidate_id, reason = 'ok' AS passed, reason, g AS good_matches,
           CASE WHEN reason IN ('too_few_good_matches', 'homography_not_found') THEN 0 ELSE i END AS inliers,
           round(CASE WHEN reason IN ('too_few_good_matches', 'homography_not_found') THEN 0.0 ELSE ratio END, 6) AS inlier_ratio,
           round(CASE WHEN reason IN ('too_few_good_matches', 'homography_not_found') THEN 0.0 ELSE qc END, 6) AS query_coverage,
           round(CASE WHEN reason IN ('too_few_good_matches', 'homography_not_found') THEN 0.0 ELSE cc END, 6) AS candidate_coverage,
           round(CASE WHEN reason IN ('too_few_good_matches', 'homography_not_found') THEN 0.0 ELSE support END, 6) AS support
    FROM r
""")
def pair_geometry_gate(ev):
    kp = ev.keypoint
    q = kp.select(F.col("image_id").alias("query_id"), F.col("kp_idx").alias("query_idx"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    c = kp.select(F.col("image_id").alias("candidate_id"), F.col("kp_idx").alias("train_idx"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    inlier = ((F.col("query_idx") * 7 + F.col("query_id")) % 5 != 0) & (F.col("query_id") % 8 != 6)
    corr = (
        LM.descriptor_match(pairs_of(ev), keypoints_of(ev)).join(q, ["query_id", "query_idx"]).join(c, ["candidate_id", "train_idx"])
        .withColumn("is_inlier", inlier)
    )
    one = [1.0, 0.0, 5.0, 0.0, 1.0, 3.0, 0.0, 0.0, 1.0]
    h = F.when(F.col("query_id") % 10 != 4, F.array(*[F.lit(v) for v in one]))
    out = LM.pair_geometry_gate(
        pairs_of(ev).withColumn("h", h), corr, ev.image_features.withColumn("extractor", F.lit("orb"))
    )
    return out.select(
        "query_id", "candidate_id", "passed", "reason", "good_matches", "inliers",
        *[F.round(x, 6).alias(x) for x in ("inlier_ratio", "query_coverage", "candidate_coverage", "support")],
    )


@query("box_projection", "fx_submission", f"""
    WITH h AS (SELECT image_id, 1 + (image_id % 7) / 100 AS a, (image_id % 5) / 1000 AS b, image_id % 400 - 100.0 AS c, (image_id % 3) / 1000 AS d, 0.9::DOUBLE AS e, image_id % 300 - 90.0 AS f,
                      (image_id % 2) / 10000 AS g, CASE WHEN image_id % 50 = 7 THEN 0.0 ELSE 640.0 END AS tw, 480.0::DOUBLE AS th FROM fx_submission),
    p AS (SELECT *, [c / 1, (a * 320 + c) / (g * 320 + 1), (a * 320 + b * 240 + c) / (g * 320 + 1), (b * 240 + c) / 1] AS xs,
                 [f / 1, (d * 320 + f) / (g * 320 + 1), (d * 320 + e * 240 + f) / (g * 320 + 1), (e * 240 + f) / 1] AS ys FROM h),
    q AS (SELECT image_id, tw, {_clamp('list_min(xs) / nullif(tw, 0)')} AS l, {_clamp('list_max(xs) / nullif(tw, 0)')} AS r, {_clamp('list_min(ys) / th')} AS t, {_clamp('list_max(ys) / th')} AS bo FROM p)
    SELECT image_id, CASE WHEN tw > 0 AND r > l AND bo > t THEN round(l, 9) END AS left, CASE WHEN tw > 0 AND r > l AND bo > t THEN round(t, 9) END AS top,
           CASE WHEN tw > 0 AND r > l AND bo > t THEN round(r - l, 9) END AS width, CASE WHEN tw > 0 AND r > l AND bo > t THEN round(bo - t, 9) END AS height
    FROM q
""")
def box_projection(ev):
    i = F.col("image_id")
    h = [1 + (i % 7) / 100, (i % 5) / 1000, i % 400 - 100.0, (i % 3) / 1000, F.lit(0.9), i % 300 - 90.0, (i % 2) / 10000,
         F.lit(0.0), F.lit(1.0)]
    tw = F.when(i % 50 == 7, 0.0).otherwise(640.0)
    box = B.project(h, F.lit(320.0), F.lit(240.0), tw, F.lit(480.0))
    return ev.submission.select("image_id", box.alias("b")).select("image_id", *_four("b", digits=9))


@query("feature_valid", "fx_feature_row", """
    SELECT image_id, extractor, CAST(keypoint_count AS BIGINT) AS keypoint_count FROM fx_feature_row
    WHERE feature_version = 1 AND extractor IN ('orb', 'akaze') AND width > 0 AND height > 0
""")
def feature_valid(ev):
    return LM.feature_valid(ev.feature_row).select("image_id", "extractor", F.col("keypoint_count").cast("bigint").alias("keypoint_count"))


@query("feature_select", "fx_feature_row", """
    WITH c AS (SELECT image_id, max(keypoint_count) FILTER (extractor = 'orb') AS o, max(keypoint_count) FILTER (extractor = 'akaze') AS a
               FROM fx_feature_row WHERE feature_version = 1 AND extractor IN ('orb', 'akaze') AND width > 0 AND height > 0 GROUP BY image_id)
    SELECT image_id, CASE WHEN o >= 140 THEN 'orb' WHEN a IS NOT NULL AND (o IS NULL OR a >= o) THEN 'akaze' ELSE 'orb' END AS extractor,
           CAST(CASE WHEN o >= 140 THEN o WHEN a IS NOT NULL AND (o IS NULL OR a >= o) THEN a ELSE o END AS BIGINT) AS keypoint_count
    FROM c WHERE o IS NOT NULL OR a IS NOT NULL
""")
def feature_select(ev):
    return LM.feature_select(LM.feature_valid(ev.feature_row))


@query("candidate_budget", "fx_feature_row fx_submission fx_registry fx_keypoint", """
    WITH u AS (SELECT DISTINCT image_id FROM fx_feature_row WHERE feature_version = 1 AND extractor IN ('orb', 'akaze') AND width > 0 AND height > 0),
    k AS (SELECT DISTINCT image_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS part, unnest([substr(d0, 1, 8), substr(d0, 9), substr(d1, 1, 8), substr(d1, 9), substr(d2, 1, 8), substr(d2, 9), substr(d3, 1, 8), substr(d3, 9)]) AS value FROM fx_keypoint),
    n AS (SELECT s.image_id AS query_id, b.image_id AS candidate_id, count(*) AS shared FROM fx_submission s JOIN fx_registry r ON s.phash = r.phash
          JOIN k a ON a.image_id = r.image_id JOIN k b ON a.part = b.part AND a.value = b.value AND b.image_id <> r.image_id JOIN u ON u.image_id = b.image_id GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, candidate_id) AS candidate_rank FROM n
""")
def candidate_budget(ev):
    return LM.local_candidates(queries_of(ev), keypoints_of(ev), LM.feature_valid(ev.feature_row))


# Pixels --------------------------------------------------------------------------------------------------------------

@query("crop_quality", "fx_crop_pixel", """
    WITH hist AS (SELECT crop_id, value, count(*) AS n FROM fx_crop_pixel GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY crop_id) AS total FROM hist),
    m AS (SELECT crop_id, CAST(max(total) AS BIGINT) AS total, -sum(n / total * log2(n / total)) AS e, sum(value * n / total) AS mean, sum(value * value * n / total) AS sq FROM t GROUP BY crop_id)
    SELECT crop_id, total, round(abs(e), 5) AS entropy, round(sqrt(greatest(sq - mean * mean, 0)), 5) AS contrast,
           e >= 0.5 OR sqrt(greatest(sq - mean * mean, 0)) >= 8.0 AS accepted
    FROM m
""")
def crop_quality(ev):
    out = PX.crop_quality(ev.crop_pixel)
    return out.select("crop_id", "total", F.abs(F.round("entropy", 5)).alias("entropy"), F.round("contrast", 5).alias("contrast"), "accepted")


@query("banner_rows", "fx_luma_row", """
    WITH px AS (SELECT image_id, y, unnest(range(len(px))) AS x, unnest(px) AS v, len(px) AS w FROM fx_luma_row),
    sm AS (SELECT image_id, y, x, w, 2 * v + coalesce(lag(v) OVER r, lead(v) OVER r) + coalesce(lead(v) OVER r, lag(v) OVER r) AS s
           FROM px WINDOW r AS (PARTITION BY image_id, y ORDER BY x)),
    gr AS (SELECT image_id, y, x, w, coalesce(abs(lead(s) OVER c - lag(s) OVER c), 0) AS g FROM sm WINDOW c AS (PARTITION BY image_id, x ORDER BY y)),
    rm AS (SELECT image_id, y, max(w) AS w, sum(g) / max(w) AS mean FROM gr GROUP BY image_id, y),
    sz AS (SELECT image_id, max(y) + 1 AS h FROM rm GROUP BY image_id),
    th AS (SELECT r.image_id, h, max(w) AS w, greatest(5.0, median(mean) FILTER (y >= floor(h * 0.2) AND y < floor(h * 0.8)) + 2.5 * stddev_pop(mean) FILTER (y >= floor(h * 0.2) AND y < floor(h * 0.8))) AS thr
           FROM rm r JOIN sz s ON r.image_id = s.image_id GROUP BY r.image_id, h),
    hit AS (SELECT g.image_id, g.y, max(mean) AS mean FROM gr g JOIN rm r ON g.image_id = r.image_id AND g.y = r.y JOIN th t ON t.image_id = g.image_id
            GROUP BY g.image_id, g.y, thr HAVING max(mean) > thr AND avg(CASE WHEN g > thr * 0.3 THEN 1.0 ELSE 0.0 END) >= 0.8),
    ed AS (SELECT t.image_id, h, w, thr, arg_min(x.mean, x.y) FILTER (x.y >= floor(h * 0.7)) AS bm, min(x.y) FILTER (x.y >= floor(h * 0.7)) AS b,
                  arg_max(x.mean, x.y) FILTER (x.y < floor(h * 0.3) + 1) AS tm, max(x.y) FILTER (x.y < floor(h * 0.3) + 1) AS t_
           FROM th t LEFT JOIN hit x ON x.image_id = t.image_id GROUP BY t.image_id, h, w, thr),
    ok AS (SELECT *, b IS NOT NULL AND h - b >= 8 AS hb, t_ IS NOT NULL AND t_ + 1 >= 8 AS ht FROM ed),
    sh AS (SELECT *, CASE WHEN ht THEN (t_ + 1) / h ELSE 0.0 END AS ts, CASE WHEN hb THEN b / h ELSE 1.0 END AS bs,
                  greatest(CASE WHEN ht THEN least(1.0, greatest(0.0, (tm - thr) / (thr + 1e-6))) ELSE 0.0 END, CASE WHEN hb THEN least(1.0, greatest(0.0, (bm - thr) / (thr + 1e-6))) ELSE 0.0 END) AS conf FROM ok),
    fin AS (SELECT *, h >= 40 AND w >= 40 AND (hb OR ht) AND bs - ts > 0.10 AS cand FROM sh)
    SELECT image_id, cand AND conf >= 0.5 AS has_overlay, round(CASE WHEN cand THEN conf ELSE 0.0 END, 6) AS confidence,
           CASE WHEN cand AND conf >= 0.5 THEN round(ts, 6) END AS top, CASE WHEN cand AND conf >= 0.5 THEN round(bs - ts, 6) END AS height,
           CASE WHEN cand AND conf >= 0.5 THEN 'Detected: ' || CASE WHEN ht AND hb THEN 'top text banner and bottom text banner' WHEN ht THEN 'top text banner' ELSE 'bottom text banner' END ELSE '' END AS method
    FROM fin
""")
def banner_rows(ev):
    out = PX.banner_rows(ev.luma_row)
    return out.select(
        "image_id", "has_overlay", F.round("confidence", 6).alias("confidence"), F.round(F.col("crop_box")[1], 6).alias("top"),
        F.round(F.col("crop_box")[3], 6).alias("height"), "method",
    )


# Every pair of copies but each fifth: all keypoints match, seven of eight agree with the transform.
COPIES = """
copies AS (SELECT k.image_id AS query_id, k.image_id + CASE WHEN k.image_id % 2 = 0 THEN 1 ELSE -1 END AS neighbor_id, count(*) AS good_matches, count(CASE WHEN kp_idx % 8 <> 3 THEN 1 END) AS inliers
           FROM fx_copy_keypoint k WHERE CAST(floor(k.image_id / 2) AS BIGINT) % 5 <> 4 GROUP BY k.image_id HAVING count(*) >= 24),
found AS (SELECT c.* FROM copies c JOIN fx_submission s ON s.image_id = c.query_id JOIN fx_registry r ON r.phash = s.phash AND r.image_id <> c.neighbor_id
          WHERE c.neighbor_id IN (SELECT image_id FROM fx_registry))
"""


def copy_matches_of(ev):
    """Local matches of the submissions by the whole flow, from descriptors on."""
    words = [H.decode_hash(F.col(d)).alias(d) for d in ("d0", "d1", "d2", "d3")]
    keypoints = ev.copy_keypoint.select("image_id", "kp_idx", *words, "x", "y")
    features = keypoints.groupBy("image_id").agg(F.count("*").alias("keypoint_count")).select(
        "image_id", F.lit("orb").alias("extractor"), F.lit(640).alias("width"), F.lit(480).alias("height"), "keypoint_count")
    queries = queries_of(ev).join(features, F.col("query_id") == F.col("image_id"), "left_semi")
    return LM.local_matches(queries, keypoints, features, ev.registry)


@query("local_matches", "fx_submission fx_registry fx_copy_keypoint", "WITH " + COPIES + """
    SELECT query_id, neighbor_id, 'orb' AS extractor, good_matches, inliers, round(inliers::DOUBLE / good_matches, 4) AS inlier_ratio, true AS homography_found,
           CASE WHEN query_id % 2 = 0 THEN 0.0625::DOUBLE ELSE 0.0::DOUBLE END AS "left", CASE WHEN query_id % 2 = 0 THEN 0.0625::DOUBLE ELSE 0.0::DOUBLE END AS top,
           CASE WHEN query_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS width, CASE WHEN query_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS height
    FROM found
""")
def local_matches(ev):
    return copy_matches_of(ev).select("query_id", "neighbor_id", "extractor", "good_matches", "inliers", "inlier_ratio", "homography_found", *_four("box"))


@query("local_match_votes", "fx_submission fx_registry fx_copy_keypoint fx_vote_event", "WITH " + COPIES + "," + HASH_PAIRS + "," + VOTES + """,
    both_ AS (SELECT query_id, neighbor_id, max(h) AS h, max(l) AS l FROM (SELECT query_id, neighbor_id, 1 AS h, 0 AS l FROM hash_pairs UNION ALL SELECT query_id, neighbor_id, 0, 1 FROM found) GROUP BY ALL)
    SELECT s.image_id AS query_id, CAST(coalesce(sum(vote_real), 0) AS BIGINT) AS vote_real, CAST(coalesce(sum(vote_edited), 0) AS BIGINT) AS vote_edited, CAST(coalesce(sum(vote_ai), 0) AS BIGINT) AS vote_ai,
           count(v.image_id) AS match_count, count(CASE WHEN l = 1 THEN v.image_id END) AS local_match_count
    FROM fx_submission s LEFT JOIN both_ b ON b.query_id = s.image_id LEFT JOIN votes v ON v.image_id = b.neighbor_id GROUP BY s.image_id
""")
def local_match_votes(ev):
    """The community roll-up with local matches from the flow."""
    sums = N.neighbor_sums(queries_of(ev), ev.registry, votes_of(ev), C.VOTE_MEASURES, copy_matches_of(ev))
    return C.human_consensus(sums).select("query_id", "vote_real", "vote_edited", "vote_ai", "match_count", "local_match_count")
