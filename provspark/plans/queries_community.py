"""Registered queries: votes, reports, consensus, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from provspark.functions import texts as T
from provspark.operators import consensus as C
from provspark.operators import ledger as L
from provspark.operators import neighbors as N
from provspark.plans.catalog import query
from provspark.plans.queries_matching import MATCHES, queries_of

# Shared oracle fragments ---------------------------------------------------------------------------------------------

VOTES = """
cur_votes AS MATERIALIZED (
  SELECT image_id, voter_id, arg_max(choice, (ts, event_id)) AS choice FROM fx_vote_event
  WHERE choice IN ('real', 'edited', 'ai') AND image_id IN (SELECT image_id FROM fx_registry)
  GROUP BY image_id, voter_id),
votes AS MATERIALIZED (
  SELECT image_id, count(CASE WHEN choice = 'real' THEN 1 END) AS vote_real, count(CASE WHEN choice = 'edited' THEN 1 END) AS vote_edited,
         count(CASE WHEN choice = 'ai' THEN 1 END) AS vote_ai
  FROM cur_votes GROUP BY image_id)
"""

NORM_REPORTS = """
norm_reports AS MATERIALIZED (
  SELECT event_id, ts, image_id, voter_id, result,
         CASE WHEN ok THEN det END AS detector, CASE WHEN ok THEN exp_prov END AS provider
  FROM (SELECT *, exp_prov IS NOT NULL AND (prov = '' OR prov = exp_prov) AS ok
        FROM (SELECT *, lower(trim(provider)) AS prov, lower(trim(detector)) AS det,
                     CASE lower(trim(detector)) WHEN 'google_about_this_image' THEN 'google'
                                                WHEN 'openai_verify' THEN 'openai' END AS exp_prov
              FROM fx_report_event)))
"""

REPORTS = NORM_REPORTS + """,
cur_reports AS MATERIALIZED (
  SELECT image_id, voter_id, provider, detector, arg_max(result, (ts, event_id)) AS result FROM norm_reports
  WHERE result IN ('detected', 'not_detected') AND detector IS NOT NULL
    AND image_id IN (SELECT image_id FROM fx_registry)
  GROUP BY image_id, voter_id, provider, detector),
by_detector AS MATERIALIZED (
  SELECT image_id, detector, min(provider) AS provider, count(CASE WHEN result = 'detected' THEN 1 END) AS detected,
         count(CASE WHEN result = 'not_detected' THEN 1 END) AS not_detected, count(*) AS total
  FROM cur_reports GROUP BY image_id, detector),
reports AS MATERIALIZED (
  SELECT image_id, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(not_detected) AS BIGINT) AS not_detected
  FROM by_detector GROUP BY image_id)
"""


# Shared Spark inputs -------------------------------------------------------------------------------------------------

def votes_of(ev):
    return L.vote_counts(L.current_votes(ev.vote_event, ev.registry))


def by_detector_of(ev):
    return L.report_by_detector(L.current_reports(ev.report_event, ev.registry))


def reports_of(ev):
    return L.report_counts(by_detector_of(ev))


def facts_of(ev):
    return ev.fact.dropDuplicates(["image_id", "analyzer", "data"])


def sums_of(ev, measures, names):
    """Measures summed over each submission's neighbors."""
    return N.neighbor_sums(queries_of(ev), ev.registry, measures, names, ev.local_match)


# Ledgers -------------------------------------------------------------------------------------------------------------

@query("vote_replay", "fx_vote_event fx_registry", """
    WITH good AS (SELECT * FROM fx_vote_event WHERE choice IN ('real', 'edited', 'ai')
                    AND image_id IN (SELECT image_id FROM fx_registry)),
    lagged AS (SELECT *, lag(choice) OVER (PARTITION BY image_id, voter_id ORDER BY ts, event_id) AS previous FROM good)
    SELECT event_id, image_id, voter_id, choice, previous,
           CASE WHEN previous IS NULL THEN 'recorded' WHEN previous = choice THEN 'unchanged' ELSE 'updated' END AS status
    FROM lagged
    UNION ALL
    SELECT event_id, image_id, voter_id, choice, NULL, 'rejected' FROM fx_vote_event
    WHERE event_id NOT IN (SELECT event_id FROM good)
""")
def vote_replay(ev):
    out = L.vote_replay(ev.vote_event, ev.registry)
    return out.select("event_id", "image_id", "voter_id", "choice", "previous", "status")


@query("report_replay", "fx_report_event fx_registry", "WITH " + NORM_REPORTS + """,
    good AS (SELECT * FROM norm_reports WHERE result IN ('detected', 'not_detected') AND detector IS NOT NULL
               AND image_id IN (SELECT image_id FROM fx_registry)),
    lagged AS (SELECT *, lag(result) OVER (PARTITION BY image_id, voter_id, provider, detector ORDER BY ts, event_id) AS previous FROM good)
    SELECT event_id, image_id, voter_id, provider, detector, result, previous,
           CASE WHEN previous IS NULL THEN 'recorded' WHEN previous = result THEN 'unchanged' ELSE 'updated' END AS status
    FROM lagged
    UNION ALL
    SELECT event_id, image_id, voter_id, provider, detector, result, NULL, 'rejected' FROM norm_reports
    WHERE event_id NOT IN (SELECT event_id FROM good)
""")
def report_replay(ev):
    return L.report_replay(ev.report_event, ev.registry).drop("ts")


@query("detector_normalize", "fx_report_event", "WITH " + NORM_REPORTS + """
    SELECT event_id, provider, detector FROM norm_reports
""")
def detector_normalize(ev):
    return L.normalize_reports(ev.report_event).select("event_id", "provider", "detector")


@query("vote_counts", "fx_vote_event fx_registry", "WITH " + VOTES + "SELECT * FROM votes")
def vote_counts(ev):
    return votes_of(ev)


@query("vote_breakdown", "fx_vote_event fx_registry", "WITH " + VOTES + """
    SELECT r.image_id, k.ord, k.kind, k.label, coalesce(CASE k.kind WHEN 'real' THEN vote_real WHEN 'edited' THEN vote_edited ELSE vote_ai END, 0) AS votes,
           coalesce(vote_real + vote_edited + vote_ai, 0) AS total,
           CASE WHEN coalesce(vote_real + vote_edited + vote_ai, 0) = 0 THEN 0.0 ELSE
             CAST(CASE k.kind WHEN 'real' THEN vote_real WHEN 'edited' THEN vote_edited ELSE vote_ai END AS DOUBLE)
               / (vote_real + vote_edited + vote_ai) * 100 END AS percent
    FROM fx_registry r LEFT JOIN votes v ON r.image_id = v.image_id,
         (VALUES (CAST(0 AS BIGINT), 'real', 'Real'), (1, 'edited', 'AI-Edited'), (2, 'ai', 'AI-Gen')) k(ord, kind, label)
""")
def vote_breakdown(ev):
    return L.vote_breakdown(ev.registry.select("image_id").join(votes_of(ev), "image_id", "left"))


@query("vote_defaults", "fx_vote_event fx_registry", "WITH " + VOTES + """
    SELECT r.image_id, coalesce(vote_real, 0) AS vote_real, coalesce(vote_edited, 0) AS vote_edited,
           coalesce(vote_ai, 0) AS vote_ai, coalesce(vote_real, 0) + coalesce(vote_edited, 0) + coalesce(vote_ai, 0) AS total_votes
    FROM fx_registry r LEFT JOIN votes v ON r.image_id = v.image_id
""")
def vote_defaults(ev):
    return L.vote_defaults(ev.registry.select("image_id").join(votes_of(ev), "image_id", "left"))


@query("voter_state", "fx_vote_event fx_report_event fx_registry", "WITH " + VOTES + "," + REPORTS + """,
    asked AS (SELECT DISTINCT image_id, voter_id FROM fx_vote_event UNION SELECT DISTINCT image_id, voter_id FROM fx_report_event)
    SELECT a.image_id, a.voter_id, v.choice AS current_vote, g.result AS report_google_about_this_image,
           o.result AS report_openai_verify, g.result AS current_report
    FROM asked a LEFT JOIN cur_votes v ON a.image_id = v.image_id AND a.voter_id = v.voter_id
    LEFT JOIN cur_reports g ON a.image_id = g.image_id AND a.voter_id = g.voter_id AND g.detector = 'google_about_this_image'
    LEFT JOIN cur_reports o ON a.image_id = o.image_id AND a.voter_id = o.voter_id AND o.detector = 'openai_verify'
""")
def voter_state(ev):
    keys = ["image_id", "voter_id"]
    asked = ev.vote_event.select(*keys).union(ev.report_event.select(*keys)).distinct()
    return L.voter_state(asked, L.current_votes(ev.vote_event, ev.registry),
                         L.current_reports(ev.report_event, ev.registry))


@query("report_by_detector", "fx_report_event fx_registry", "WITH " + REPORTS + "SELECT * FROM by_detector")
def report_by_detector(ev):
    return by_detector_of(ev)


@query("report_backfill", "fx_report_old", """
    SELECT id, image_id, voter_id,
           CASE WHEN provider IS NULL OR detector IS NULL OR source_kind IS NULL THEN 'google' ELSE provider END AS provider,
           CASE WHEN provider IS NULL OR detector IS NULL OR source_kind IS NULL THEN 'google_about_this_image' ELSE detector END AS detector,
           CASE WHEN provider IS NULL OR detector IS NULL OR source_kind IS NULL THEN 'manual_user_report' ELSE source_kind END AS source_kind
    FROM fx_report_old
""")
def report_backfill(ev):
    return L.report_backfill(ev.report_old)


@query("report_downgrade_dedup", "fx_report_old", """
    SELECT * FROM fx_report_old WHERE id IN (SELECT min(id) FROM fx_report_old GROUP BY image_id, voter_id)
""")
def report_downgrade_dedup(ev):
    return L.report_downgrade_dedup(ev.report_old)


# Roll-ups over neighbors ---------------------------------------------------------------------------------------------

@query("human_consensus", "fx_submission fx_registry fx_local_match fx_vote_event", "WITH " + MATCHES + "," + VOTES + """,
    agg AS (SELECT query_id, sum(vote_real) AS r, sum(vote_edited) AS e, sum(vote_ai) AS a, count(*) AS n,
                   count(CASE WHEN NOT is_self_match THEN 1 END) AS d, count(CASE WHEN has_local THEN 1 END) AS l
            FROM matches m JOIN votes v ON m.neighbor_id = v.image_id GROUP BY query_id),
    num AS (SELECT s.image_id AS query_id, CAST(coalesce(r, 0) AS BIGINT) AS vote_real, CAST(coalesce(e, 0) AS BIGINT) AS vote_edited,
                   CAST(coalesce(a, 0) AS BIGINT) AS vote_ai, coalesce(n, 0) AS match_count, coalesce(d, 0) AS distant_match_count,
                   coalesce(l, 0) AS local_match_count, CAST(coalesce(r, 0) + coalesce(e, 0) + coalesce(a, 0) AS BIGINT) AS total_votes
            FROM fx_submission s LEFT JOIN agg ON s.image_id = agg.query_id)
    SELECT *, CASE WHEN match_count > 0 THEN 'FOUND' ELSE 'NOT FOUND' END AS status,
      CASE WHEN distant_match_count > 0 THEN distant_match_count || ' similar image' || CASE WHEN distant_match_count = 1 THEN '' ELSE 's' END
             || ' with ' || total_votes || ' votes total.'
           WHEN match_count > 0 THEN total_votes || ' direct vote' || CASE WHEN total_votes = 1 THEN '' ELSE 's' END || ' recorded.'
           ELSE 'No community consensus yet.' END AS summary,
      CASE WHEN distant_match_count = 1 THEN 'Similar image with votes:' WHEN distant_match_count > 1 THEN 'Similar images with votes:' ELSE '' END AS matches_summary
    FROM num
""")
def human_consensus(ev):
    return C.human_consensus(sums_of(ev, votes_of(ev), C.VOTE_MEASURES))


@query("watermark_score", "fx_submission fx_registry fx_local_match fx_report_event", "WITH " + MATCHES + "," + REPORTS + """,
    agg AS (SELECT query_id,
              sum(CASE WHEN is_self_match THEN CASE WHEN detected > 0 AND not_detected >= 3 * detected THEN 0 ELSE detected END
                       WHEN least(pd, wd) = 0 THEN 0.75 * detected ELSE 0.5 * detected END) AS score,
              sum(CASE WHEN is_self_match THEN detected ELSE 0 END) AS sd, sum(CASE WHEN is_self_match THEN not_detected ELSE 0 END) AS sn,
              sum(detected) AS td, sum(not_detected) AS tn, count(CASE WHEN NOT is_self_match THEN 1 END) AS sim, count(*) AS n
            FROM matches m JOIN reports r ON m.neighbor_id = r.image_id GROUP BY query_id),
    num AS (SELECT s.image_id AS query_id, CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(coalesce(sd, 0) AS BIGINT) AS self_detected,
                   CAST(coalesce(sn, 0) AS BIGINT) AS self_not_detected, CAST(coalesce(td, 0) AS BIGINT) AS total_detected,
                   CAST(coalesce(tn, 0) AS BIGINT) AS total_not_detected, coalesce(sim, 0) AS similar_count, coalesce(n, 0) AS n
            FROM fx_submission s LEFT JOIN agg ON s.image_id = agg.query_id)
    SELECT * EXCLUDE (n),
      self_detected > 0 AND self_not_detected > 0 AND self_not_detected >= self_detected AND self_not_detected <= 3 * self_detected AS contested,
      CASE WHEN score = 0 AND n = 0 THEN 'MANUAL' WHEN score = 0 THEN 'CHECKED' WHEN score < 4 THEN 'REPORTED' ELSE 'DETECTED' END AS status,
      CASE WHEN score = 0 AND n = 0 THEN 'Check for invisible SynthID watermarking.'
           WHEN score = 0 THEN 'Checked by ' || (total_detected + total_not_detected) || ' user' || CASE WHEN total_detected + total_not_detected = 1 THEN '' ELSE 's' END || ', not detected on this version.'
           WHEN score < 4 THEN total_detected || ' user' || CASE WHEN total_detected = 1 THEN '' ELSE 's' END || ' reported detecting SynthID'
             || CASE WHEN self_detected = 0 AND total_detected > 0 THEN ' on a similar image.' ELSE '.' END
           ELSE 'SynthID detected by ' || total_detected || ' user' || CASE WHEN total_detected = 1 THEN '' ELSE 's' END || '.' END AS summary,
      CASE WHEN score = 0 AND n = 0 THEN 'manual' WHEN score = 0 THEN 'checked' WHEN score < 4 THEN 'reported' ELSE 'detected' END AS display_state,
      CASE WHEN score <> 0 AND score < 4 THEN 'Verify this yourself; SynthID checks are provider-specific and can vary across different copies of an image.' END AS caveat
    FROM num
""")
def watermark_score(ev):
    return C.watermark_score(sums_of(ev, C.reported(reports_of(ev)), C.REPORT_MEASURES))


@query("detector_totals", "fx_submission fx_registry fx_local_match fx_report_event", "WITH " + MATCHES + "," + REPORTS + """
    SELECT s.image_id AS query_id, c.detector, c.ord, c.provider, c.label, c.short_label, c.check_label,
           CAST(coalesce(x.d, 0) AS BIGINT) AS detected, CAST(coalesce(x.n, 0) AS BIGINT) AS not_detected,
           CAST(coalesce(x.d, 0) + coalesce(x.n, 0) AS BIGINT) AS total
    FROM fx_submission s CROSS JOIN (VALUES (CAST(0 AS BIGINT), 'google_about_this_image', 'google', 'Google About this image', 'Google', 'Check Google'),
         (1, 'openai_verify', 'openai', 'OpenAI Verify', 'OpenAI', 'OpenAI Verify')) c(ord, detector, provider, label, short_label, check_label)
    LEFT JOIN (SELECT query_id, detector, sum(detected) AS d, sum(not_detected) AS n FROM matches m JOIN by_detector b ON m.neighbor_id = b.image_id
               GROUP BY query_id, detector) x ON x.query_id = s.image_id AND x.detector = c.detector
""")
def detector_totals(ev):
    return C.detector_totals(sums_of(ev, *C.detector_measures(by_detector_of(ev))))


FACTS = "facts AS (SELECT DISTINCT image_id, analyzer, data FROM fx_fact)"

VERDICT = VOTES + "," + REPORTS + "," + FACTS + """,
verdicts AS MATERIALIZED (
  SELECT r.image_id, coalesce(vote_real, 0) AS vote_real, coalesce(vote_edited, 0) AS vote_edited, coalesce(vote_ai, 0) AS vote_ai,
         EXISTS (SELECT 1 FROM facts f WHERE f.image_id = r.image_id AND analyzer = 'c2pa') AS c2pa,
         coalesce(vote_real + vote_edited + vote_ai, 0) AS total_votes,
         CASE WHEN coalesce(vote_real + vote_edited + vote_ai, 0) > 0 THEN
           CASE WHEN vote_real >= vote_edited AND vote_real >= vote_ai THEN 'real' WHEN vote_edited >= vote_ai THEN 'edited' ELSE 'ai' END END AS verdict,
         CASE WHEN p.detected > p.not_detected THEN true WHEN p.not_detected > p.detected THEN false END AS synthid
  FROM fx_registry r LEFT JOIN votes v ON r.image_id = v.image_id LEFT JOIN reports p ON r.image_id = p.image_id)
"""


def verdicts_of(ev, images=None):
    images = ev.registry.select("image_id") if images is None else images
    return C.image_verdict(images, votes_of(ev), facts_of(ev), reports_of(ev))


@query("image_verdict", "fx_registry fx_vote_event fx_report_event fx_fact", "WITH " + VERDICT + "SELECT * FROM verdicts")
def image_verdict(ev):
    return verdicts_of(ev)


@query("fact_matches", "fx_submission fx_registry fx_local_match fx_fact", "WITH " + MATCHES + "," + FACTS + """,
    res AS (SELECT image_id AS query_id, CASE image_id % 5 WHEN 0 THEN 'FOUND' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'NOT AVAILABLE' ELSE 'NOT FOUND' END AS status,
                   'tool said so' AS summary FROM fx_submission),
    cnt AS (SELECT query_id, count(*) AS n FROM matches m JOIN facts f ON m.neighbor_id = f.image_id AND f.analyzer = 'c2pa'
            WHERE NOT is_self_match GROUP BY query_id),
    num AS (SELECT r.*, CASE WHEN status IN ('ERROR', 'NOT AVAILABLE') THEN 0 ELSE coalesce(n, 0) END AS match_count
            FROM res r LEFT JOIN cnt c ON r.query_id = c.query_id)
    SELECT query_id, CASE WHEN status = 'NOT FOUND' AND match_count > 0 THEN 'SIMILAR' ELSE status END AS status,
           CASE WHEN status = 'NOT FOUND' AND match_count > 0 THEN 'Found ' || match_count || ' visually similar image'
                || CASE WHEN match_count = 1 THEN '' ELSE 's' END || ' with C2PA metadata.' ELSE summary END AS summary,
           match_count, match_count > 0 AS has_distant_matches
    FROM num
""")
def fact_matches(ev):
    m = F.col("image_id") % 5
    status = F.when(m == 0, "FOUND").when(m == 1, "ERROR").when(m == 2, "NOT AVAILABLE").otherwise("NOT FOUND")
    results = ev.submission.select(
        F.col("image_id").alias("query_id"), status.alias("status"), F.lit("tool said so").alias("summary")
    )
    return C.fact_matches(results, sums_of(ev, C.signed_measures(facts_of(ev)), ["facts"]))


# Money and keys ------------------------------------------------------------------------------------------------------

CENTS = """
cents AS (SELECT payment_id, amount, CAST(coalesce(round(TRY_CAST(CASE WHEN trim(amount) <> '' THEN trim(amount) END AS DECIMAL(28, 10)) * 100, 0), 0) AS BIGINT) AS cents
          FROM fx_payment)
"""


@query("amount_to_cents", "fx_payment", "WITH " + CENTS + "SELECT payment_id, amount, cents FROM cents")
def amount_to_cents(ev):
    return ev.payment.withColumn("cents", T.amount_to_cents(F.col("amount")))


@query("donation_total", "fx_payment", "WITH " + CENTS + """
    SELECT total_cents, round(least(CAST(total_cents AS DOUBLE) / 20000, 1.0) * 100, 2) AS progress_percent, total_cents >= 20000 AS goal_met
    FROM (SELECT CAST(coalesce(sum(cents), 0) AS BIGINT) AS total_cents FROM cents WHERE cents > 0)
""")
def donation_total(ev):
    from provspark.operators.donations import donation_progress, donation_total as total
    return donation_progress(total(ev.payment))


@query("voter_key", "events", """
    SELECT event_id, sha256(CAST(user_id AS VARCHAR) || ':pepper') AS voter_id FROM events
""")
def voter_key(ev):
    return ev.table("events").select("event_id", T.voter_key(F.col("user_id").cast("string"), "pepper").alias("voter_id"))
