"""Registered queries: traces, analyzers, reports, stored rows, quotas, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from provspark.operators import ledger as L
from provspark.operators import metadata as MD
from provspark.operators import quotas as Q
from provspark.operators import traces as TC
from provspark.plans import analyzers as A
from provspark.plans.catalog import ORACLES, query
from provspark.plans.queries_community import FACTS, REPORTS, VOTES, by_detector_of, facts_of, reports_of, votes_of
from provspark.plans.queries_evidence import FINDINGS
from provspark.plans.queries_matching import MATCHES, matches_of, queries_of
from provspark.session import cut_lineage, work_folder
from provspark.sources import tables as TB
from provspark.streaming import jobs as S

# Neighbors and traces ------------------------------------------------------------------------------------------------

@query("neighbor_details", "fx_submission fx_registry fx_local_match fx_vote_event fx_report_event fx_fact fx_source",
       "WITH " + MATCHES + "," + VOTES + "," + REPORTS + "," + FACTS + """
    SELECT query_id, neighbor_id, match_method, vote_real, vote_edited, vote_ai, coalesce(s.n, 0) AS source_count, coalesce(f.n, 0) AS fact_count, detected, not_detected
    FROM matches m LEFT JOIN votes v ON v.image_id = m.neighbor_id LEFT JOIN reports r ON r.image_id = m.neighbor_id
    LEFT JOIN (SELECT image_id, count(DISTINCT url) AS n FROM fx_source GROUP BY image_id) s ON s.image_id = m.neighbor_id
    LEFT JOIN (SELECT image_id, count(*) AS n FROM facts GROUP BY image_id) f ON f.image_id = m.neighbor_id
""")
def neighbor_details(ev):
    pairs = matches_of(ev).select("query_id", "neighbor_id", "match_method")
    return TC.neighbor_details(pairs, votes_of(ev), ev.source.distinct(), facts_of(ev), reports_of(ev))


@query("neighbor_evidence", "fx_submission fx_registry fx_local_match fx_fact fx_source", "WITH " + MATCHES + "," + FACTS + """
    SELECT query_id, neighbor_id, 'source' AS kind, url AS item FROM matches m JOIN (SELECT DISTINCT image_id, url FROM fx_source) s ON s.image_id = m.neighbor_id
    UNION ALL SELECT query_id, neighbor_id, 'fact:' || analyzer, data FROM matches m JOIN facts f ON f.image_id = m.neighbor_id
""")
def neighbor_evidence(ev):
    return TC.neighbor_evidence(matches_of(ev), ev.source.distinct(), facts_of(ev))


@query("sources_top3", "fx_source", """
    SELECT image_id, url, rank FROM (SELECT image_id, url, row_number() OVER (PARTITION BY image_id ORDER BY url) AS rank FROM (
      SELECT DISTINCT image_id, CASE WHEN image_id % 4 = 0 AND url LIKE 'https://pbs%' THEN '' ELSE url END AS url FROM fx_source))
    WHERE rank <= 3 AND url <> ''
""")
def sources_top3(ev):
    url = F.when((F.col("image_id") % 4 == 0) & F.col("url").startswith("https://pbs"), "").otherwise(F.col("url"))
    rows = ev.source.select("image_id", url.alias("url")).distinct()
    return TC.top_sources(rows).withColumn("rank", F.col("rank").cast("bigint"))


DISTANT = MATCHES + "," + VOTES + "," + REPORTS + "," + FACTS + """,
sig AS (SELECT image_id, count(*) AS n FROM facts WHERE analyzer = 'c2pa' GROUP BY image_id),
distant AS MATERIALIZED (
  SELECT query_id, neighbor_id, match_method, kinds, CAST(CASE WHEN match_method <> 'local' THEN CASE WHEN wd <= pd THEN wd ELSE pd END END AS BIGINT) AS distance, c2pa_facts, total_votes, detected, not_detected,
         row_number() OVER (PARTITION BY query_id ORDER BY CASE match_method WHEN 'hybrid' THEN 0 WHEN 'local' THEN 1 ELSE 2 END, kinds DESC, n_created DESC, neighbor_id) AS rank
  FROM (SELECT m.*, sig.n AS c2pa_facts, vote_real + vote_edited + vote_ai AS total_votes, detected, not_detected,
               (sig.n IS NOT NULL)::BIGINT + (v.image_id IS NOT NULL)::BIGINT + (r.image_id IS NOT NULL)::BIGINT AS kinds
        FROM matches m LEFT JOIN sig ON sig.image_id = m.neighbor_id LEFT JOIN votes v ON v.image_id = m.neighbor_id LEFT JOIN reports r ON r.image_id = m.neighbor_id
        WHERE NOT is_self_match) WHERE kinds > 0)
"""


def distant_of(ev):
    carried = TC.carried_evidence(votes_of(ev), facts_of(ev), reports_of(ev))
    return TC.distant_traces(matches_of(ev, carried), carried)


@query("distant_traces", "fx_submission fx_registry fx_local_match fx_vote_event fx_report_event fx_fact", "WITH " + DISTANT + "SELECT * FROM distant")
def distant_traces(ev):
    return distant_of(ev).select(
        "query_id", "neighbor_id", "match_method", "kinds", F.col("distance").cast("bigint").alias("distance"), "c2pa_facts",
        "total_votes", "detected", "not_detected", "rank",
    )


def direct_of(ev):
    status = MD.ai_metadata(ev.registry, MD.normalize_keys(ev.metadata))
    return TC.direct_traces(ev.registry, facts_of(ev), votes_of(ev), by_detector_of(ev), status)


@query("direct_traces", "fx_registry fx_fact fx_vote_event fx_report_event fx_metadata", "WITH " + VOTES + "," + REPORTS + "," + FACTS + "," + FINDINGS + """,
    c AS (SELECT image_id, count(*) AS n, string_agg(data, ' | ' ORDER BY data) AS d FROM facts WHERE analyzer = 'c2pa' GROUP BY image_id),
    h AS (SELECT *, vote_real + vote_edited + vote_ai AS n FROM votes),
    s AS (SELECT image_id, sum(total)::BIGINT AS n, sum(detected)::BIGINT AS d, sum(not_detected)::BIGINT AS x,
                 string_agg(CASE detector WHEN 'openai_verify' THEN 'OpenAI' ELSE 'Google' END || ': ' || detected || ' detected / ' || not_detected || ' not detected', ' | ' ORDER BY detector) AS l FROM by_detector GROUP BY image_id),
    e AS (SELECT image_id, count(*) AS n FROM finds GROUP BY image_id),
    u AS (SELECT image_id, CAST(0 AS BIGINT) AS ord, 'c2pa' AS kind, 'Direct C2PA' AS title, n || ' direct C2PA fact' || CASE WHEN n = 1 THEN '' ELSE 's' END || '.' AS summary, d AS details FROM c
          UNION ALL SELECT image_id, 1, 'human', 'Direct Consensus', n || ' vote' || CASE WHEN n = 1 THEN '' ELSE 's' END || ': ' || vote_real || ' real / ' || vote_edited || ' edited / ' || vote_ai || ' AI.', '' FROM h
          UNION ALL SELECT image_id, 2, 'synthid', 'Direct SynthID Reports', n || ' report' || CASE WHEN n = 1 THEN '' ELSE 's' END || ': ' || d || ' detected / ' || x || ' not detected.', l FROM s
          UNION ALL SELECT image_id, 3, 'exif', 'Direct AI Metadata', n || ' metadata finding' || CASE WHEN n = 1 THEN '' ELSE 's' END || '.', '' FROM e)
    SELECT * FROM u WHERE image_id IN (SELECT image_id FROM fx_registry)
""")
def direct_traces(ev):
    return direct_of(ev).withColumn("details", F.array_join("details", " | "))


# Analyzers -----------------------------------------------------------------------------------------------------------

def inputs_of(ev, queries=None):
    return A.Inputs(
        queries=queries_of(ev) if queries is None else queries,
        registry=ev.registry, local=ev.local_match,
        votes=votes_of(ev), reports=reports_of(ev), facts=facts_of(ev),
        manifests=ev.manifest, chunks=ev.metadata,
    )


def _json(fields: str) -> str:
    """JSON text of the named columns without nulls."""
    return "json_merge_patch('{}', json_object(" + ", ".join(f"'{f}', {f}" for f in fields.split()) + "))::VARCHAR"


def _analyzer_rows(slugs: str) -> str:
    """Rows of the analyzers from the SQL of what they summarise, with texts and names written out."""
    parts = {
        "c2pa": f"""SELECT query_id, 'c2pa' AS slug, 'Digital Signature (C2PA)' AS name, CASE WHEN st = 'NOT FOUND' AND match_count > 0 THEN 'SIMILAR' ELSE st END AS status,
                CASE WHEN st = 'NOT FOUND' AND match_count > 0 THEN 'Found ' || match_count || ' visually similar image' || CASE WHEN match_count = 1 THEN '' ELSE 's' END || ' with C2PA metadata.' ELSE su END AS summary,
                {_json('signer tool origin_label provenance_depth manifest_label manifest_count manifest_title manifest_format match_count has_distant_matches')} AS data
            FROM (SELECT *, match_count > 0 AS has_distant_matches FROM (
              SELECT s.image_id AS query_id, coalesce(m.status, 'NOT FOUND') AS st, coalesce(m.summary, 'No C2PA signature found.') AS su, m.* EXCLUDE (image_id, status, summary),
                     CASE WHEN coalesce(m.status, '') IN ('ERROR', 'NOT AVAILABLE') THEN 0 ELSE coalesce(c.n, 0) END AS match_count
              FROM fx_submission s LEFT JOIN ({ORACLES['manifest_active']}) m ON m.image_id = s.image_id
              LEFT JOIN (SELECT query_id, count(*) AS n FROM matches x JOIN facts f ON x.neighbor_id = f.image_id AND f.analyzer = 'c2pa' WHERE NOT is_self_match GROUP BY query_id) c ON c.query_id = s.image_id))""",
        "synthid": f"""SELECT query_id, 'synthid' AS slug, 'SynthID Watermark' AS name, status, summary,
                {_json('display_state score contested self_detected self_not_detected total_detected total_not_detected similar_count has_distant_matches caveat')} AS data
            FROM (SELECT *, similar_count > 0 AS has_distant_matches FROM ({ORACLES['watermark_score']}))""",
        "tineye": """SELECT image_id AS query_id, 'tineye' AS slug, 'TinEye Reverse Search' AS name, 'MANUAL' AS status, 'Search for this image across the web.' AS summary,
                '{"allow_manual_refresh":true}' AS data FROM fx_submission""",
        "exif": f"""SELECT s.image_id AS query_id, 'exif' AS slug, 'AI Metadata (EXIF)' AS name, coalesce(status, 'NOT FOUND') AS status, coalesce(summary, 'No AI EXIF metadata detected.') AS summary,
                '{{"finding_count":' || coalesce(finding_count, 0) || '}}' AS data FROM fx_submission s LEFT JOIN ({ORACLES['ai_metadata_status']}) m ON m.image_id = s.image_id""",
        "human": f"""SELECT query_id, 'human' AS slug, 'Human Consensus' AS name, status, summary,
                {_json('vote_real vote_edited vote_ai total_votes match_count distant_match_count local_match_count matches_summary')} AS data FROM ({ORACLES['human_consensus']})""",
    }
    picked = [f"SELECT *, CAST({i} AS BIGINT) AS ord FROM ({parts[s]})" for i, s in enumerate(slugs.split())]
    return "WITH " + MATCHES + "," + FACTS + ", rows_ AS (" + " UNION ALL BY NAME ".join(picked) + ")"


_RUN_ON = "fx_submission fx_registry fx_local_match fx_fact"


@query("analyzer_registry", _RUN_ON, _analyzer_rows("c2pa synthid tineye exif human") + """
    SELECT query_id, ord, slug, name, CASE WHEN query_id % 50 = 3 THEN 'ERROR' ELSE status END AS status,
           CASE WHEN query_id % 50 = 3 THEN 'Analysis expired. Please re-run.' ELSE summary END AS summary, CASE WHEN query_id % 50 = 3 THEN '{}' ELSE data END AS data FROM rows_
""")
def analyzer_registry(ev):
    expired = ev.submission.filter("image_id % 50 = 3").select(F.col("image_id").alias("query_id"))
    return A.run_analyzers(inputs_of(ev), expired=expired)


@query("batch_analyzers", _RUN_ON, _analyzer_rows("c2pa synthid exif human") + "SELECT query_id, ord, slug, name, status, summary, data FROM rows_")
def batch_analyzers(ev):
    return A.run_analyzers(inputs_of(ev), A.BATCH_ANALYZERS)


STORED = """
stored AS MATERIALIZED (SELECT analysis_id, slug, arg_max({'status': status, 'summary': summary, 'data': data, 'mode': mode}, seq) AS r, max(seq) AS seq FROM fx_analyzer_row GROUP BY analysis_id, slug)
"""


def stored_of(ev):
    return A.latest_rows(ev.analyzer_row)


@query("analyzer_matrix", "fx_analyzer_row", "WITH " + STORED + """
    SELECT a.analysis_id, c.ord, c.slug, c.name, CASE WHEN s.slug IS NULL THEN 'NOT_RUN' ELSE coalesce(s.r.status, 'UNKNOWN') END AS status,
           CASE WHEN s.slug IS NULL THEN 'Analyzer row is not available yet.' ELSE s.r.summary END AS summary,
           CASE WHEN starts_with(coalesce(s.r.data, ''), '{') THEN s.r.data ELSE '{}' END AS data
    FROM (SELECT DISTINCT analysis_id FROM fx_analyzer_row) a
    CROSS JOIN (VALUES (CAST(0 AS BIGINT), 'c2pa', 'Digital Signature (C2PA)'), (1, 'synthid', 'SynthID Watermark'), (2, 'tineye', 'TinEye Reverse Search'),
                       (3, 'exif', 'AI Metadata (EXIF)'), (4, 'human', 'Human Consensus')) c(ord, slug, name)
    LEFT JOIN stored s ON s.analysis_id = a.analysis_id AND s.slug = c.slug
""")
def analyzer_matrix(ev):
    return A.analyzer_matrix(ev.analyzer_row.select("analysis_id").distinct(), stored_of(ev))


EVID = STORED + """,
evid AS (SELECT analysis_id, slug, status, CASE WHEN summary <> '' THEN summary WHEN status = 'MANUAL' THEN 'Manual check required' WHEN status = 'LOADING' THEN 'Running…' ELSE '' END AS summary
         FROM (SELECT analysis_id, slug, upper(coalesce(r.status, 'LOADING')) AS status, r.summary AS summary FROM stored WHERE slug <> 'tineye'))
"""


@query("evidence_summary", "fx_analyzer_row", "WITH " + EVID + "SELECT * FROM evid")
def evidence_summary(ev):
    return A.evidence_summary(stored_of(ev))


@query("evidence_notable", "fx_analyzer_row", "WITH " + EVID + """
    SELECT analysis_id, bool_or(status IN ('FOUND', 'DETECTED', 'SIMILAR')) AS has_notable_evidence, count(*) AS rows FROM evid GROUP BY analysis_id
""")
def evidence_notable(ev):
    return A.evidence_notable(A.evidence_summary(stored_of(ev)))


def _row_json(broken):
    text = F.to_json(F.struct("status", "summary", "data"))
    return F.when(broken, F.substring(text, 1, 9)).otherwise(text)


@query("analyzer_rows_sink", "fx_analyzer_row", """
    SELECT analysis_id, slug, seq FROM fx_analyzer_row WHERE slug <> 'tineye' OR mode = 'derived'
""")
def analyzer_rows_sink(ev):
    path = work_folder(ev.spark, "rows")
    rows = A.persistable(ev.analyzer_row).withColumn("row_json", _row_json(F.lit(False)))
    A.write_rows(rows, path)
    return ev.spark.read.schema("analysis_id bigint, seq bigint, slug string").parquet(path)


@query("analyzer_rows_source", "fx_analyzer_row", """
    WITH kept AS (SELECT * FROM fx_analyzer_row WHERE slug <> 'tineye' OR mode = 'derived'),
    last AS (SELECT analysis_id, slug, max(seq) AS seq FROM kept GROUP BY analysis_id, slug)
    SELECT k.analysis_id, k.slug, k.seq, k.status, k.summary FROM kept k JOIN last l ON k.analysis_id = l.analysis_id AND k.slug = l.slug AND k.seq = l.seq
    WHERE k.seq % 10 <> 9
""")
def analyzer_rows_source(ev):
    path = work_folder(ev.spark, "rows")
    rows = A.persistable(ev.analyzer_row).withColumn("row_json", _row_json(F.col("seq") % 10 == 9))
    A.write_rows(rows, path)
    return A.read_rows(ev.spark, path).drop("data")


@query("metadata_merge", "orders", """
    WITH base AS (SELECT o_orderkey AS analysis_id, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT analysis_id, 'status' AS key, CASE WHEN analysis_id % 3 = 0 THEN 'new' ELSE o_orderstatus END AS value FROM base
    UNION ALL SELECT analysis_id, 'priority', o_orderpriority FROM base
    UNION ALL SELECT analysis_id, 'added', 'yes' FROM base WHERE analysis_id % 3 = 0
""")
def metadata_merge(ev):
    orders = ev.table("orders")
    text = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    bad = F.when(F.col("o_orderkey") % 14 == 0, "{broken").otherwise(F.lit(None).cast("string"))
    base = orders.select(
        F.col("o_orderkey").alias("analysis_id"),
        F.when(F.col("o_orderkey") % 7 == 0, bad).otherwise(text).alias("metadata_json"),
    )
    updates = orders.filter("o_orderkey % 3 = 0").select(
        F.col("o_orderkey").alias("analysis_id"),
        F.create_map(F.lit("status"), F.lit("new"), F.lit("added"), F.lit("yes")).alias("update"),
    )
    merged = A.metadata_merge(base, updates)
    return merged.select("analysis_id", F.explode("metadata").alias("key", "value"))


# The report as the test data give it, from the analyzers' rows, direct items and distant traces of the SQL above.
EXPORT = _analyzer_rows("c2pa synthid tineye exif human") + "," + DISTANT.removeprefix(MATCHES + ",").replace("," + FACTS, "", 1) + "," + FINDINGS + """,
direct AS (
  SELECT image_id, list({'kind': kind, 'title': title, 'summary': summary, 'details': details} ORDER BY ord) AS items FROM (
    SELECT image_id, 0 AS ord, 'c2pa' AS kind, 'Direct C2PA' AS title, count(*) || ' direct C2PA fact' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || '.' AS summary, list(data ORDER BY data) AS details
    FROM facts WHERE analyzer = 'c2pa' GROUP BY image_id
    UNION ALL SELECT image_id, 1, 'human', 'Direct Consensus', n || ' vote' || CASE WHEN n = 1 THEN '' ELSE 's' END || ': ' || vote_real || ' real / ' || vote_edited || ' edited / ' || vote_ai || ' AI.', []
    FROM (SELECT *, vote_real + vote_edited + vote_ai AS n FROM votes)
    UNION ALL SELECT image_id, 2, 'synthid', 'Direct SynthID Reports', sum(total) || ' report' || CASE WHEN sum(total) = 1 THEN '' ELSE 's' END || ': ' || sum(detected) || ' detected / ' || sum(not_detected) || ' not detected.',
      list(CASE detector WHEN 'openai_verify' THEN 'OpenAI' ELSE 'Google' END || ': ' || detected || ' detected / ' || not_detected || ' not detected' ORDER BY detector) FROM by_detector GROUP BY image_id
    UNION ALL SELECT image_id, 3, 'exif', 'Direct AI Metadata', count(*) || ' metadata finding' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || '.', [] FROM finds GROUP BY image_id)
  GROUP BY image_id),
subject AS (SELECT s.image_id AS id, s.phash, s.whash, r.image_id AS registry_id, CASE WHEN s.image_id % 3 <> 0 THEN 'https%3A%2F%2Fimg.example%2F' || s.phash END AS enc
            FROM fx_submission s JOIN fx_registry r ON r.phash = s.phash)
SELECT id AS analysis_id, 'report' AS section, CAST(0 AS BIGINT) AS ord, json_object(
    'report_version', '1.1', 'app_version', '2.0', 'generated_at', '2026-01-01T00:00:00Z',
    'analysis', json_object('id', id, 'created_at', strftime(TIMESTAMP '2024-01-01' + to_hours(id), '%Y-%m-%dT%H:%M:%SZ'), 'source', 'url', 'mime', 'image/png',
      'dimensions', json_object('width', 640, 'height', 480),
      'crop_box', CASE WHEN id % 2 = 0 THEN json_object('left', 0.0::DOUBLE, 'top', 0.1::DOUBLE, 'width', 1.0::DOUBLE, 'height', 0.9::DOUBLE) END),
    'hashes', json_object('phash', phash, 'whash', whash, 'registry_id', registry_id),
    'analyzers', (SELECT to_json(list({'name': name, 'slug': slug, 'status': status, 'summary': summary, 'data': data} ORDER BY ord)) FROM rows_ WHERE rows_.query_id = id),
    'direct_traces', coalesce((SELECT to_json(items) FROM direct WHERE direct.image_id = registry_id), '[]'::JSON),
    'distant_match_count', (SELECT count(*) FROM distant WHERE distant.query_id = id),
    'tools', to_json([{'name': 'Reverse Image Search', 'links': CASE WHEN enc IS NOT NULL THEN [
        {'label': 'Google', 'url': 'https://lens.google.com/upload?url=' || enc}, {'label': 'Bing', 'url': 'https://www.bing.com/images/search?view=detailv2&iss=sbi&form=SBIHMP&q=imgurl:' || enc},
        {'label': 'TinEye', 'url': 'https://tineye.com/search?url=' || enc}]
      ELSE [{'label': 'Google', 'url': 'https://images.google.com/'}, {'label': 'Bing', 'url': 'https://www.bing.com/visualsearch'}] END}]))::VARCHAR AS line
FROM subject
UNION ALL
SELECT d.query_id, 'distant_match', d.rank, json_object(
    'rank', d.rank, 'image_id', d.neighbor_id, 'phash', m.n_phash, 'whash', m.n_whash, 'created_at', strftime(m.n_created, '%Y-%m-%dT%H:%M:%SZ'),
    'phash_distance', m.pd, 'whash_distance', m.wd, 'distance', d.distance, 'hash_display', CASE WHEN wd <= pd THEN n_whash || ' (whash)' ELSE n_phash || ' (phash)' END,
    'match_method', d.match_method, 'match_method_label', CASE d.match_method WHEN 'hybrid' THEN 'Hybrid (hash + local)' WHEN 'local' THEN 'Local geometric' ELSE 'Hash' END,
    'c2pa_facts', d.c2pa_facts, 'vote_real', v.vote_real, 'vote_edited', v.vote_edited, 'vote_ai', v.vote_ai, 'total_votes', d.total_votes, 'detected', d.detected, 'not_detected', d.not_detected)::VARCHAR
FROM distant d JOIN matches m ON m.query_id = d.query_id AND m.neighbor_id = d.neighbor_id LEFT JOIN votes v ON v.image_id = d.neighbor_id
"""


@query("report_export", "fx_submission fx_registry fx_local_match fx_fact fx_vote_event fx_report_event fx_metadata", EXPORT)
def report_export(ev):
    reg = queries_of(ev)
    analyses = reg.select(
        F.col("query_id").alias("analysis_id"), (F.lit(1704067200) + F.col("query_id") * 3600).alias("created_s"),
        F.lit("url").alias("source"), F.lit("image/png").alias("mime"), F.lit(640).alias("width"), F.lit(480).alias("height"),
        F.when(F.col("query_id") % 2 == 0, F.array(F.lit(0.0), F.lit(0.1), F.lit(1.0), F.lit(0.9))).alias("crop_box"),
        "phash", "whash", "registry_id",
        F.when(F.col("query_id") % 3 != 0, F.concat(F.lit("https://img.example/"), "phash")).alias("public_url"),
    )
    rows = A.run_analyzers(inputs_of(ev)).withColumnRenamed("query_id", "analysis_id")
    distant = cut_lineage(ev.spark, A.report_matches(distant_of(ev)), "distant")
    return A.report_lines(analyses, rows, direct_of(ev), distant, "2026-01-01T00:00:00Z", "2.0")


@query("load_tables", "fx_registry fx_vote_event fx_report_event fx_fact fx_source fx_link_event fx_keypoint fx_payment", "WITH " + VOTES + """
    SELECT 'image_registry' AS relation, count(*) AS rows, count(DISTINCT image_id) AS ids FROM fx_registry
    UNION ALL SELECT 'vote_event', count(*), count(DISTINCT image_id) FROM fx_vote_event
    UNION ALL SELECT 'report_event', count(*), count(DISTINCT image_id) FROM fx_report_event
    UNION ALL SELECT 'provenance_fact', count(*), count(DISTINCT image_id) FROM fx_fact
    UNION ALL SELECT 'image_source', count(*), count(DISTINCT image_id) FROM fx_source
    UNION ALL SELECT 'image_containment', count(*), count(DISTINCT link_id) FROM fx_link_event
    UNION ALL SELECT 'image_local_features', count(*), count(DISTINCT image_id) FROM fx_keypoint
    UNION ALL SELECT 'image_consensus', count(*), count(DISTINCT image_id) FROM votes
    UNION ALL SELECT 'payment_event', count(*), count(DISTINCT payment_id) FROM fx_payment
""")
def load_tables(ev):
    from functools import reduce

    from provspark.plans.queries_geometry import keypoints_of

    root = work_folder(ev.spark, "relations")
    sources = {
        "image_registry": ev.registry, "vote_event": ev.vote_event, "report_event": ev.report_event,
        "provenance_fact": ev.fact, "image_source": ev.source,
        "image_containment": ev.link_event.withColumn("crop_box", F.array("l", "t", "w", "h")),
        "image_local_features": keypoints_of(ev), "image_consensus": votes_of(ev), "payment_event": ev.payment,
    }
    for name, df in sources.items():
        TB.write_relation(df, root, name)
    parts = [
        df.agg(F.count("*").alias("rows"), F.countDistinct(df.columns[0] if name in (
            "image_registry", "provenance_fact", "image_source", "image_containment", "image_local_features", "image_consensus",
            "payment_event") else "image_id").alias("ids")).select(F.lit(name).alias("relation"), "rows", "ids")
        for name, df in TB.load_tables(ev.spark, root).items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


# Quotas and streams --------------------------------------------------------------------------------------------------

_RULES = (Q.Quota("key_day", 2, 86400, True), Q.Quota("all_hour", 12, 3600, False))


@query("quota_windows", "fx_request", """
    SELECT 'key_day' AS quota, event_id, key AS request_key, CAST(key AS VARCHAR) AS scope, w * 86400 AS window_start_s FROM (
      SELECT *, row_number() OVER (PARTITION BY key, w ORDER BY ts, event_id) AS rn FROM (SELECT *, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS w FROM fx_request)) WHERE rn > 2
    UNION ALL
    SELECT 'all_hour', event_id, key, 'global', w * 3600 FROM (
      SELECT *, row_number() OVER (PARTITION BY w ORDER BY ts, event_id) AS rn FROM (SELECT *, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS w FROM fx_request)) WHERE rn > 12
""")
def quota_windows(ev):
    return Q.over_quota(ev.request, _RULES)


def _event_stream(ev):
    return S.read_events(ev.spark, ev.sf_dir, "events.parquet", ev.table("events").schema)


@query("stream_vote_state", "fx_vote_event fx_registry", """
    SELECT image_id, count(CASE WHEN choice = 'real' THEN 1 END) AS vote_real, count(CASE WHEN choice = 'edited' THEN 1 END) AS vote_edited, count(CASE WHEN choice = 'ai' THEN 1 END) AS vote_ai
    FROM (SELECT image_id, voter_id, arg_max(choice, (ts, event_id)) AS choice FROM fx_vote_event WHERE choice IN ('real', 'edited', 'ai')
          AND image_id IN (SELECT image_id FROM fx_registry) GROUP BY image_id, voter_id)
    GROUP BY image_id
""")
def stream_vote_state(ev):
    events = _event_stream(ev).filter("event_type <> 'signup'").select(
        "event_id", "ts", (F.get_json_object("props", "$.k").cast("bigint") + 100 * F.expr("user_id DIV 15")).alias("image_id"),
        F.sha2(F.concat(F.col("user_id").cast("string"), F.lit(":fixture")), 256).alias("voter_id"),
        F.when(F.col("event_type") == "view", "real").when(F.col("event_type") == "click", "edited")
        .when(F.col("event_type") == "purchase", "ai").otherwise("unsure").alias("choice"),
    )
    path = work_folder(ev.spark, "votes")
    S.run_updates_to_files(S.vote_states(events, ev.registry), f"{path}/out", f"{path}/checkpoint")
    return L.vote_counts(S.latest_states(ev.spark, f"{path}/out"))


@query("stream_donations", "", """
    SELECT CAST(sum(round(CAST(o_totalprice AS DECIMAL(18, 2)) * 100, 0)) AS BIGINT) AS total_cents FROM orders WHERE o_totalprice > 0
""")
def stream_donations(ev):
    payments = S.read_events(ev.spark, ev.sf_dir, "orders.parquet", ev.table("orders").schema).select(
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount")
    )
    name = f"donations_{uuid.uuid4().hex}"
    S.run_to_memory(S.donation_stream(payments), name, f"{work_folder(ev.spark, 'donations')}/checkpoint")
    return ev.spark.table(name)


_STREAM_RULES = (Q.Quota("key_hour", 2, 3600, True), Q.Quota("all_hour", 12, 3600, False))
_SETTLED = "(w + 1) * 3600 <= (SELECT epoch(date_trunc('milliseconds', max(ts))) - 600 FROM events)"


@query("stream_quota_flags", "", f"""
    WITH r AS (SELECT event_id, user_id AS key, ts, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS w FROM events)
    SELECT 'key_hour' AS quota, event_id, key AS request_key, CAST(key AS VARCHAR) AS scope, w * 3600 AS window_start_s FROM (
      SELECT *, row_number() OVER (PARTITION BY key, w ORDER BY ts, event_id) AS rn FROM r) WHERE rn > 2 AND {_SETTLED}
    UNION ALL
    SELECT 'all_hour', event_id, key, 'global', w * 3600 FROM (
      SELECT *, row_number() OVER (PARTITION BY w ORDER BY ts, event_id) AS rn FROM r) WHERE rn > 12 AND {_SETTLED}
""")
def stream_quota_flags(ev):
    path, parts = work_folder(ev.spark, "flags"), []
    for q in _STREAM_RULES:
        requests = _event_stream(ev).select("event_id", F.col("user_id").alias("key"), "ts")
        S.run_quota_flags(requests, q, f"{path}/{q.name}", f"{path}/{q.name}-checkpoint")
        parts.append(S.settled_flags(ev.spark, f"{path}/{q.name}", q))
    return parts[0].unionByName(parts[1])


@query("stream_quota_counts", "", """
    SELECT user_id AS key, w * 3600 AS window_start_s, count(*) AS requests FROM (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS w FROM events)
    WHERE (w + 1) * 3600 <= (SELECT epoch(date_trunc('milliseconds', max(ts))) - 600 FROM events) GROUP BY user_id, w
""")
def stream_quota_counts(ev):
    requests = _event_stream(ev).select(F.col("user_id").alias("key"), "ts")
    path = work_folder(ev.spark, "quota")
    S.run_to_files(S.quota_counts(requests, 3600), f"{path}/out", f"{path}/checkpoint")
    return ev.spark.read.schema("key bigint, window_start_s bigint, requests bigint").parquet(f"{path}/out")
