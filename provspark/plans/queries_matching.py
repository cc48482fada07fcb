"""Registered queries: hashes, neighbors, registry, local matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from provspark.functions import boxes as B
from provspark.functions import hashing as H
from provspark.operators import neighbors as N
from provspark.operators import registry as R
from provspark.plans.catalog import query
from provspark.plans.fixtures import Evidence

# Shared oracle fragments ---------------------------------------------------------------------------------------------

_U64 = "('0x' || {0})::UBIGINT"


def _dist(a: str, b: str) -> str:
    return f"bit_count(xor({_U64.format(a)}, {_U64.format(b)}))"


HASH_PAIRS = f"""
hash_pairs AS MATERIALIZED (
  SELECT s.image_id AS query_id, r.image_id AS neighbor_id,
         CAST({_dist('s.phash', 'r.phash')} AS BIGINT) AS phash_distance,
         CAST({_dist('s.whash', 'r.whash')} AS BIGINT) AS whash_distance
  FROM fx_submission s, fx_registry r
  WHERE {_dist('s.phash', 'r.phash')} <= 4 OR {_dist('s.whash', 'r.whash')} <= 3)
"""

# All pairs with their method, the query's registry id, both hashes and the displayed distance.
MATCHES = HASH_PAIRS + f""",
both_pairs AS (
  SELECT coalesce(h.query_id, l.query_id) AS query_id, coalesce(h.neighbor_id, l.neighbor_id) AS neighbor_id,
         CASE WHEN h.query_id IS NOT NULL AND l.query_id IS NOT NULL THEN 'hybrid'
              WHEN l.query_id IS NOT NULL THEN 'local' ELSE 'hash' END AS match_method,
         l.query_id IS NOT NULL AS has_local
  FROM hash_pairs h FULL JOIN fx_local_match l ON h.query_id = l.query_id AND h.neighbor_id = l.neighbor_id),
matches AS MATERIALIZED (
  SELECT p.*, q.registry_id, q.registry_id = p.neighbor_id AS is_self_match, r.phash AS n_phash, r.whash AS n_whash,
         r.created_at AS n_created,
         {_dist('q.phash', 'r.phash')} AS pd, {_dist('q.whash', 'r.whash')} AS wd
  FROM both_pairs p
  JOIN (SELECT s.image_id AS query_id, s.phash, s.whash, g.image_id AS registry_id
        FROM fx_submission s JOIN fx_registry g ON s.phash = g.phash) q ON q.query_id = p.query_id
  JOIN fx_registry r ON r.image_id = p.neighbor_id)
"""


# Shared Spark inputs -------------------------------------------------------------------------------------------------

def queries_of(ev: Evidence):
    """Each submission with the registry row of its hash."""
    reg = ev.registry.select("phash", F.col("image_id").alias("registry_id"))
    return ev.submission.select(F.col("image_id").alias("query_id"), "phash", "whash").join(reg, "phash")


def hash_pairs_of(ev: Evidence, registry=None):
    subs = ev.submission.select(F.col("image_id").alias("query_id"), "phash", "whash")
    return N.hash_neighbors(subs, ev.registry if registry is None else registry)


def matches_of(ev: Evidence, carrying=None):
    """Hash and local matches with distances; ``carrying`` (image_id) narrows the registry to images worth matching."""
    registry = ev.registry
    local = ev.local_match.select("query_id", "neighbor_id", "inliers")
    if carrying is not None:
        keep = carrying.select("image_id").distinct()
        registry = registry.join(keep, "image_id", "left_semi")
        local = local.join(keep.withColumnRenamed("image_id", "neighbor_id"), "neighbor_id", "left_semi")
    pairs = N.with_local_matches(hash_pairs_of(ev, registry), local)
    return N.add_distances(pairs, queries_of(ev), registry).withColumn("has_local", F.col("inliers").isNotNull())


# Hash columns --------------------------------------------------------------------------------------------------------

@query("hash_decode", "fx_submission", """
    SELECT image_id, h AS hash_text,
           CASE WHEN regexp_full_match(h, '[0-9a-fA-F]{16}') THEN
             CAST(CASE WHEN ('0x' || h)::UBIGINT >= 9223372036854775808 THEN ('0x' || h)::UBIGINT::HUGEINT - 18446744073709551616
                       ELSE ('0x' || h)::UBIGINT::HUGEINT END AS BIGINT) END AS hash64
    FROM (SELECT image_id, CASE WHEN image_id % 10 = 7 THEN 'zz' || substr(phash, 3) WHEN image_id % 10 = 8 THEN substr(phash, 1, 15)
                 WHEN image_id % 10 = 9 THEN '' WHEN image_id % 10 = 6 THEN upper(phash) ELSE phash END AS h FROM fx_submission)
""")
def hash_decode(ev):
    m = F.col("image_id") % 10
    h = (
        F.when(m == 7, F.concat(F.lit("zz"), F.substring("phash", 3, 14))).when(m == 8, F.substring("phash", 1, 15))
        .when(m == 9, "").when(m == 6, F.upper("phash")).otherwise(F.col("phash"))
    )
    rows = ev.submission.select("image_id", h.alias("hash_text"))
    return rows.withColumn("hash64", H.decode_hash(F.col("hash_text")))


@query("hash_distance", "fx_submission", f"""
    SELECT image_id, CAST(CASE WHEN image_id % 7 <> 0 THEN {_dist('phash', 'whash')} END AS BIGINT) AS distance
    FROM fx_submission
""")
def hash_distance(ev):
    other = F.when(F.col("image_id") % 7 != 0, F.col("whash"))
    return ev.submission.select(
        "image_id", H.distance(H.decode_hash(F.col("phash")), H.decode_hash(other)).cast("bigint").alias("distance")
    )


@query("hash_neighbors", "fx_submission fx_registry", "WITH " + HASH_PAIRS + "SELECT * FROM hash_pairs")
def hash_neighbors(ev):
    return hash_pairs_of(ev).select(
        "query_id", "neighbor_id", F.col("phash_distance").cast("bigint").alias("phash_distance"),
        F.col("whash_distance").cast("bigint").alias("whash_distance"),
    )


@query("neighbor_display", "fx_submission fx_registry fx_local_match", "WITH " + MATCHES + """
    SELECT query_id, neighbor_id, is_self_match, CAST(pd AS BIGINT) AS phash_distance, CAST(wd AS BIGINT) AS whash_distance,
           CAST(CASE WHEN wd <= pd THEN wd ELSE pd END AS BIGINT) AS display_distance,
           CASE WHEN wd <= pd THEN n_whash || ' (whash)' ELSE n_phash || ' (phash)' END AS hash_display,
           match_method,
           CASE match_method WHEN 'hybrid' THEN 'Hybrid (hash + local)' WHEN 'local' THEN 'Local geometric' ELSE 'Hash' END AS match_method_label
    FROM matches
""")
def neighbor_display(ev):
    big = [F.col(c).cast("bigint").alias(c) for c in ("phash_distance", "whash_distance", "display_distance")]
    return matches_of(ev).select(
        "query_id", "neighbor_id", "is_self_match", *big, "hash_display", "match_method",
        H.method_label(F.col("match_method")).alias("match_method_label"),
    )


@query("match_method", "fx_submission fx_registry fx_local_match", "WITH " + MATCHES + """
    SELECT match_method, count(*) AS pairs, count(CASE WHEN is_self_match THEN 1 END) AS self_pairs FROM matches GROUP BY match_method
""")
def match_method(ev):
    return N.method_counts(queries_of(ev), ev.registry, ev.local_match)


@query("neighbor_local_struct", "fx_local_match", """
    SELECT query_id, neighbor_id, CASE WHEN query_id % 8 = 0 THEN 'orb' ELSE extractor END AS extractor,
           CAST(good_matches AS BIGINT) AS good_matches,
           CAST(CASE WHEN query_id % 6 = 0 THEN 0 ELSE inliers END AS BIGINT) AS inliers,
           CASE WHEN query_id % 10 = 0 THEN 0.0 ELSE round(inlier_ratio, 4) END AS inlier_ratio
    FROM fx_local_match
""")
def neighbor_local_struct(ev):
    q = F.col("query_id")
    e = H.local_evidence(
        F.when(q % 8 != 0, F.col("extractor")), F.col("good_matches"), F.when(q % 6 != 0, F.col("inliers")),
        F.when(q % 10 != 0, F.col("inlier_ratio")),
    )
    return ev.local_match.select("query_id", "neighbor_id", e.alias("e")).select("query_id", "neighbor_id", "e.*")


@query("self_match_rule", "fx_submission fx_registry fx_local_match", "WITH " + MATCHES + """
    SELECT query_id, count(CASE WHEN NOT coalesce(
               CASE WHEN neighbor_id % 3 = 0 THEN is_self_match END,
               CASE WHEN neighbor_id % 3 = 1 THEN is_self_match END,
               pd = 0 AND (wd = 0 OR neighbor_id % 4 = 2)) THEN 1 END) AS distant_match_count
    FROM matches GROUP BY query_id
""")
def self_match_rule(ev):
    n = F.col("neighbor_id")
    own = H.is_self_match(
        F.when(n % 3 == 0, F.col("is_self_match")), F.when(n % 3 == 1, n), F.col("registry_id"),
        F.col("neighbor_phash"), F.col("query_phash"),
        F.when(n % 4 != 2, F.col("neighbor_whash")), F.col("query_whash"),
    )
    return N.distant_counts(queries_of(ev), ev.registry, ev.local_match, own)


# Registry ------------------------------------------------------------------------------------------------------------

@query("registry_upsert", "fx_submission fx_registry", """
    WITH existing AS (SELECT * FROM fx_registry WHERE image_id % 3 = 0),
    fresh AS (SELECT phash, arg_min(whash, image_id) AS whash, arg_min(created_at, image_id) AS created_at
              FROM fx_submission WHERE phash NOT IN (SELECT phash FROM existing) GROUP BY phash)
    SELECT image_id, phash, whash, CAST(epoch(created_at) AS BIGINT) AS created_s FROM existing
    UNION ALL
    SELECT (SELECT max(image_id) FROM existing) + row_number() OVER (ORDER BY substr(md5(phash), 1, 4), phash),
           phash, whash, CAST(epoch(created_at) AS BIGINT) FROM fresh
""")
def registry_upsert(ev):
    existing = ev.registry.filter("image_id % 3 = 0")
    out = R.registry_upsert(existing, ev.submission, ["image_id"])
    return out.select("image_id", "phash", "whash", F.unix_seconds("created_at").alias("created_s"))


@query("source_upsert", "fx_registry fx_source", """
    SELECT DISTINCT r.image_id, s.url
    FROM (SELECT image_id, CASE WHEN image_id % 7 = 3 THEN '' ELSE url END AS url FROM fx_source) s
    JOIN fx_registry r ON r.image_id = s.image_id
    WHERE s.url <> '' AND NOT (s.url LIKE 'https://i.redd.it/%' AND r.image_id % 2 = 0)
""")
def source_upsert(ev):
    existing = ev.source.filter("url like 'https://i.redd.it/%' and image_id % 2 = 0")
    # Submissions arrive by hash: the registry hash of each source row, or an unknown one.
    hashes = ev.registry.select("image_id", "phash")
    submitted = ev.source.join(hashes, "image_id", "left").select(
        F.coalesce("phash", F.lit("ffff")).alias("phash"),
        F.when(F.col("image_id") % 7 == 3, "").otherwise(F.col("url")).alias("url"),
    )
    return R.source_upsert(existing, ev.registry, submitted)


@query("fact_upsert", "fx_fact", """
    SELECT DISTINCT image_id, 'c2pa' AS analyzer, data
    FROM (SELECT image_id, CASE WHEN analyzer = 'c2pa' THEN 'FOUND' ELSE 'NOT FOUND' END AS status, data FROM fx_fact) f
    WHERE status = 'FOUND' AND NOT EXISTS (
      SELECT 1 FROM fx_fact e WHERE e.image_id % 4 = 1 AND e.analyzer = 'c2pa' AND e.image_id = f.image_id AND e.data = f.data)
""")
def fact_upsert(ev):
    existing = ev.fact.filter("image_id % 4 = 1")
    results = ev.fact.select(
        "image_id", F.when(F.col("analyzer") == "c2pa", "FOUND").otherwise("NOT FOUND").alias("status"),
        F.col("data").alias("summary"),
    )
    return R.fact_upsert(existing, results)
