"""Registered queries: signed manifests, trust, embedded metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from provspark.functions import texts as X
from provspark.operators import manifests as M
from provspark.operators import metadata as MD
from provspark.operators import trust as TR
from provspark.plans.catalog import query

# Oracle fragments ----------------------------------------------------------------------------------------------------

STORES = """
st AS (SELECT image_id, CASE WHEN json_valid(manifest_json) THEN manifest_json::JSON END AS s FROM fx_manifest),
act AS MATERIALIZED (SELECT image_id, s, json_extract(s, '$.manifests.' || json_extract_string(s, '$.active_manifest')) AS m FROM st),
fnd AS MATERIALIZED (SELECT * FROM act WHERE m IS NOT NULL)
"""

ASSERTIONS = STORES + """,
asrt AS MATERIALIZED (
  SELECT image_id, i AS pos, coalesce(nullif(json_extract_string(a, '$.label'), ''), json_extract_string(a, '$.url'), '') AS label, json_extract(a, '$.data') AS data
  FROM (SELECT image_id, unnest(range(json_array_length(m, '$.assertions')::BIGINT)) AS i, unnest(json_extract(m, '$.assertions[*]')) AS a FROM fnd))
"""

ACTIONS = ASSERTIONS + """,
raw_act AS (
  SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY pos, i) - 1 AS pos, x FROM (
    SELECT image_id, pos, unnest(range(json_array_length(data, '$.actions')::BIGINT)) AS i, unnest(json_extract(data, '$.actions[*]')) AS x
    FROM asrt WHERE contains(lower(label), 'actions'))),
fld AS (
  SELECT image_id, pos, trim(coalesce(json_extract_string(x, '$.action'), '')) AS action,
         coalesce(json_extract_string(x, '$.digitalSourceType'), json_extract_string(x, '$.parameters.digitalSourceType'), '') AS digital_source_type,
         CASE WHEN json_type(x, '$.softwareAgent') = 'OBJECT' THEN json_extract_string(x, '$.softwareAgent.name') || ' ' || json_extract_string(x, '$.softwareAgent.version')
              ELSE trim(coalesce(json_extract_string(x, '$.softwareAgent'), '')) END AS software_agent
  FROM raw_act),
acts AS MATERIALIZED (
  SELECT *, CASE action WHEN 'c2pa.created' THEN 'Created' WHEN 'c2pa.opened' THEN 'Opened' WHEN 'c2pa.edited' THEN 'Edited'
                        WHEN 'c2pa.color_adjustments' THEN 'Color Adjustments' WHEN 'acme.do-it' THEN 'Acme.Do It' END AS action_display,
         CASE WHEN d IN ('trainedalgorithmicmedia', 'compositewithtrainedalgorithmicmedia') THEN 'ai'
              WHEN d IN ('digitalcapture', 'computationalcapture') THEN 'camera' END AS origin_signal
  FROM (SELECT *, lower(replace(replace(regexp_extract(digital_source_type, '([^/]*)$', 1), '-', ''), '_', '')) AS d FROM fld)),
orig AS MATERIALIZED (
  SELECT image_id, string_agg(DISTINCT origin_signal, ',' ORDER BY origin_signal) AS signals FROM acts GROUP BY image_id)
"""

_LABEL = """CASE signals WHEN 'ai,camera' THEN 'Mixed signal: AI generation and camera capture' WHEN 'ai' THEN 'Generative AI signal'
            WHEN 'camera' THEN 'Camera capture signal' ELSE '' END"""


@query("manifest_active", "fx_manifest", "WITH " + ACTIONS + f"""
    SELECT a.image_id, CASE WHEN s IS NULL THEN 'ERROR' WHEN m IS NULL THEN 'NOT FOUND' ELSE 'FOUND' END AS status,
           CASE WHEN s IS NULL THEN 'Failed to read C2PA manifest' WHEN m IS NULL THEN 'No C2PA signature found.'
                ELSE 'Signed by ' || signer || CASE WHEN {_LABEL} <> '' THEN ' (' || {_LABEL} || ')' ELSE '' END END AS summary,
           signer, tool, CAST(depth AS BIGINT) AS provenance_depth, CASE WHEN m IS NOT NULL THEN 'm1' END AS manifest_label,
           CASE WHEN m IS NOT NULL THEN CAST(2 AS BIGINT) END AS manifest_count, json_extract_string(m, '$.title') AS manifest_title,
           json_extract_string(m, '$.format') AS manifest_format, CASE WHEN m IS NOT NULL THEN '' END AS manifest_instance_id,
           CASE WHEN m IS NOT NULL THEN {_LABEL} END AS origin_label
    FROM (SELECT *, CASE WHEN m IS NOT NULL THEN coalesce(json_extract_string(m, '$.signature_info.issuer'), json_extract_string(m, '$.claim_generator'), 'Unknown signer') END AS signer,
                 CASE WHEN m IS NOT NULL THEN coalesce(json_extract_string(m, '$.claim_generator'), '') END AS tool,
                 json_array_length(m, '$.ingredients') AS depth FROM act) a LEFT JOIN orig o ON a.image_id = o.image_id
""")
def manifest_active(ev):
    return M.manifest_active(ev.manifest)


@query("manifest_assertions", "fx_manifest", "WITH " + ASSERTIONS + "SELECT image_id, pos, label, data::VARCHAR AS data FROM asrt")
def manifest_assertions(ev):
    return M.manifest_assertions(ev.manifest)


@query("manifest_actions", "fx_manifest", "WITH " + ACTIONS + "SELECT * EXCLUDE (d) FROM acts")
def manifest_actions(ev):
    return M.manifest_actions(ev.manifest)


@query("origin_signal", "fx_manifest", "WITH " + ACTIONS + """
    SELECT image_id, pos, digital_source_type, origin_signal FROM acts WHERE digital_source_type <> ''
""")
def origin_signal(ev):
    rows = M.manifest_actions(ev.manifest).filter("digital_source_type <> ''")
    return rows.select("image_id", "pos", "digital_source_type", M.origin_signal(F.col("digital_source_type")).alias("origin_signal"))


@query("origin_label", "fx_manifest", "WITH " + ACTIONS + f"""
    SELECT f.image_id, coalesce(signals, '') AS origin_signals, {_LABEL} AS origin_label FROM fnd f LEFT JOIN orig o ON f.image_id = o.image_id
""")
def origin_label(ev):
    rows = M.with_actions(M.found(M.parse_stores(ev.manifest, "actions")))
    return rows.select("image_id", F.array_join("origin_signals", ",").alias("origin_signals"), M.origin_label(F.col("origin_signals")).alias("origin_label"))


@query("capture_details", "fx_manifest", "WITH " + ASSERTIONS + f"""
    ,ex AS (SELECT image_id, pos, unnest(json_keys(data)) AS k, data FROM asrt WHERE contains(lower(label), 'stds.exif') OR contains(lower(label), 'c2pa.exif')),
    kv AS (SELECT image_id, pos, lower(k) AS k, trim(json_extract_string(data, '$.' || k)) AS v FROM ex)
    SELECT f.image_id, {', '.join(f"arg_min(v, pos) FILTER (k = '{raw.lower()}' AND v <> '') AS {name}" for raw, name in M.CAPTURE_KEYS)}
    FROM fnd f LEFT JOIN kv ON kv.image_id = f.image_id GROUP BY f.image_id
""")
def capture_details(ev):
    return M.capture_details(ev.manifest)


_STATUSES = STORES + """,
items AS MATERIALIZED (
  SELECT image_id, 1 AS src, 0 AS ing, unnest(range(json_array_length(s, '$.validation_status')::BIGINT)) AS i, unnest(json_extract(s, '$.validation_status[*]')) AS x FROM fnd
  UNION ALL
  SELECT image_id, 2, ing, unnest(range(json_array_length(g, '$.validation_status')::BIGINT)), unnest(json_extract(g, '$.validation_status[*]'))
  FROM (SELECT image_id, unnest(range(json_array_length(m, '$.ingredients')::BIGINT)) AS ing, unnest(json_extract(m, '$.ingredients[*]')) AS g FROM fnd)),
stat AS MATERIALIZED (
  SELECT image_id, t AS status_text, row_number() OVER (PARTITION BY image_id ORDER BY o) - 1 AS pos FROM (
    SELECT image_id, t, min(o) AS o FROM (
      SELECT image_id, CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' ELSE x::VARCHAR END AS t, row_number() OVER (PARTITION BY image_id ORDER BY src, ing, i) AS o FROM items)
    GROUP BY image_id, t))
"""

_CODES = _STATUSES + """,
res AS (SELECT image_id, unnest(json_extract(m, '$.validation_results.*.success[*]') || json_extract(m, '$.validation_results.*.failure[*]')) AS x FROM fnd),
codes AS MATERIALIZED (
  SELECT DISTINCT image_id, lower(trim(CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' ELSE coalesce(x ->> '$.code', x ->> '$.status') END)) AS code
  FROM (SELECT image_id, x FROM items UNION ALL SELECT image_id, x FROM res))
"""


@query("validation_status_list", "fx_manifest", "WITH " + _STATUSES + "SELECT * FROM stat")
def validation_status_list(ev):
    return M.validation_status_list(ev.manifest)


@query("validation_codes", "fx_manifest", "WITH " + _CODES + "SELECT * FROM codes")
def validation_codes(ev):
    return M.validation_codes(ev.manifest)


@query("signature_status", "fx_manifest", "WITH " + _STATUSES + """
    SELECT f.image_id, CASE WHEN json_array_length(m, '$.validation_results.activeManifest.failure') > 0
        OR EXISTS (SELECT 1 FROM stat x WHERE x.image_id = f.image_id AND regexp_matches(lower(status_text), 'invalid|mismatch|failure|untrusted|revoked')) THEN 'invalid'
      WHEN json_array_length(m, '$.validation_results.activeManifest.success') > 0
        OR EXISTS (SELECT 1 FROM stat x WHERE x.image_id = f.image_id AND regexp_matches(lower(status_text), 'validated|trusted')) THEN 'valid' END AS signature_status
    FROM fnd f
""")
def signature_status(ev):
    return M.signature_status(ev.manifest)


@query("ingredient_summary", "fx_manifest", "WITH " + STORES + """
    SELECT image_id, ing AS pos, g ->> '$.title' AS title, g ->> '$.relationship' AS relationship, CAST(coalesce(json_array_length(g, '$.validation_status'), 0) AS BIGINT) AS n_statuses
    FROM (SELECT image_id, unnest(range(json_array_length(m, '$.ingredients')::BIGINT)) AS ing, unnest(json_extract(m, '$.ingredients[*]')) AS g FROM fnd)
""")
def ingredient_summary(ev):
    return M.ingredient_summary(ev.manifest).select(
        "image_id", "pos", F.col("fields")["title"].alias("title"), F.col("fields")["relationship"].alias("relationship"),
        F.size("validation_status").cast("bigint").alias("n_statuses"),
    )


@query("generator_info", "fx_manifest", "WITH " + STORES + """
    SELECT image_id, i AS pos, CASE WHEN v <> '' THEN n || ' ' || v ELSE n END AS generator FROM (
      SELECT image_id, i, coalesce(g ->> '$.name', g ->> '$.identifier', '') AS n, coalesce(g ->> '$.version', '') AS v FROM (
        SELECT image_id, unnest(range(json_array_length(m, '$.claim_generator_info')::BIGINT)) AS i, unnest(json_extract(m, '$.claim_generator_info[*]')) AS g FROM fnd))
    WHERE n <> ''
""")
def generator_info(ev):
    return M.generator_info(ev.manifest)


@query("signature_info", "fx_manifest", "WITH " + STORES + """
    SELECT image_id, field, m ->> ('$.signature_info.' || field) AS value FROM fnd, (VALUES ('issuer'), ('alg'), ('time'), ('cert_serial_number')) t(field)
    WHERE coalesce(m ->> ('$.signature_info.' || field), '') <> ''
""")
def signature_info(ev):
    return M.signature_info(ev.manifest)


def _certs(ev):
    """Manifests with certificate end dates as a certificate reader would deliver them, some missing."""
    days = F.col("image_id") % 1000 - 500
    end = F.timestamp_seconds(F.lit(1767225600) + days * 86400 + 3600)
    issuer = F.when(F.col("image_id") % 5 != 0, F.concat(F.lit("CA "), F.col("image_id") % 7))
    return ev.manifest.withColumn("cert_not_after", F.when(F.col("image_id") % 3 != 0, end)).withColumn("cert_issuer_cn", issuer)


def _sql_case(values: dict, col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _trust_oracle(compat: bool) -> str:
    def trusted(part: str) -> str:
        if compat:
            return f"bool_or(contains(code, '{part}') AND contains(code, 'trusted'))"
        return (f"(bool_or(contains(code, '{part}') AND contains(code, 'trusted') AND NOT contains(code, 'untrusted'))"
                f" AND NOT bool_or(contains(code, '{part}') AND contains(code, 'untrusted')))")

    caveats = " || ".join(f"CASE WHEN {c} = '{v}' THEN '{sev}: {text}|' ELSE '' END" for c, v, sev, text in TR.CAVEATS)
    return "WITH " + _CODES + f""",
    flags AS (SELECT f.image_id, coalesce({trusted('timestamp')}, false) AS tt, coalesce(bool_or(contains(code, 'timestamp')), false) AS tm, coalesce({trusted('signingcredential')}, false) AS ct,
                     coalesce(bool_or(contains(code, 'signingcredential') AND contains(code, 'untrusted')), false) AS cu, coalesce(bool_or(contains(code, 'expired')), false) AS ex,
                     coalesce(bool_or(contains(code, 'revoked')), false) AS rv, any_value(m ->> '$.signature_info.time') AS tim
              FROM fnd f LEFT JOIN codes c ON f.image_id = c.image_id GROUP BY f.image_id),
    base AS (SELECT image_id, CASE WHEN tt THEN 'rfc3161' WHEN tm THEN 'rfc3161_unverified' WHEN coalesce(tim, '') <> '' THEN 'clock_only' ELSE 'none' END AS timestamp_type,
                    CASE WHEN ct THEN 'trust_list' WHEN cu THEN 'untrusted' ELSE 'unverified' END AS trust_tier, rv AS cert_revoked,
                    CASE WHEN ex THEN true WHEN image_id % 3 <> 0 THEN 0 > (image_id % 1000 - 500) * 86400 + 3600 END AS cert_expired,
                    CASE WHEN image_id % 3 <> 0 THEN strftime(make_timestamp((1767225600 + (image_id % 1000 - 500) * 86400 + 3600) * 1000000), '%Y-%m-%dT%H:%M:%S') END AS cert_expiry_date,
                    CASE WHEN image_id % 5 <> 0 THEN 'CA ' || (image_id % 7) END AS cert_issuer_cn,
                    CASE WHEN image_id % 3 <> 0 THEN image_id % 1000 - 500 END AS cert_days_until_expiry FROM flags),
    dur AS (SELECT *, CASE WHEN cert_revoked THEN 'revoked' WHEN timestamp_type = 'rfc3161' AND cert_expired THEN 'expired_with_tsa' WHEN cert_expired THEN 'expired_no_tsa'
                           WHEN timestamp_type = 'rfc3161' THEN 'durable' ELSE 'at_risk' END AS durability FROM base)
    SELECT *, {_sql_case(TR.TRUST_LABELS, 'trust_tier')} AS trust_label, {_sql_case(TR.TIMESTAMP_LABELS, 'timestamp_type')} AS timestamp_label,
           {_sql_case(TR.DURABILITY_LABELS, 'durability')} AS durability_label,
           {_sql_case(TR.SUMMARY_BY_TIER, 'trust_tier')} || ' · ' || {_sql_case(TR.SUMMARY_BY_DURABILITY, 'durability')} AS summary_line,
           CASE WHEN durability IN ('expired_no_tsa', 'revoked') THEN 'error' WHEN trust_tier IN ('untrusted', 'unverified') OR durability = 'at_risk' THEN 'warning'
                WHEN durability = 'durable' THEN 'good' ELSE 'info' END AS overall_severity,
           {caveats} AS caveats, {caveats} <> '' AS has_caveats
    FROM dur
    """


def _trust(ev, compat: bool):
    out = TR.trust_assessment(_certs(ev), F.timestamp_seconds(F.lit(1767225600)), compat)
    text = F.array_join(F.transform("caveats", lambda c: F.concat(c["severity"], F.lit(": "), c["text"], F.lit("|"))), "")
    return out.withColumn("caveats", text)


@query("trust_assessment", "fx_manifest", _trust_oracle(False))
def trust_assessment(ev):
    return _trust(ev, compat=False)


@query("trust_assessment_compat", "fx_manifest", _trust_oracle(True))
def trust_assessment_compat(ev):
    return _trust(ev, compat=True)


# Metadata ------------------------------------------------------------------------------------------------------------

@query("meta_key_normalize", "fx_metadata", """
    SELECT image_id, key AS raw_key, CASE WHEN starts_with(key, 'EXIF ') THEN substr(key, 6) WHEN starts_with(key, 'Image ') THEN substr(key, 7) ELSE key END AS key FROM fx_metadata
    UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '40962' ELSE '40963' END, CASE WHEN doc_id % 2 = 0 THEN 'PixelXDimension' ELSE 'PixelYDimension' END FROM documents
""")
def meta_key_normalize(ev):
    tags = ev.table("documents").select(
        F.col("doc_id").alias("image_id"), F.when(F.col("doc_id") % 2 == 0, "40962").otherwise("40963").alias("key")
    )
    raw = ev.metadata.select("image_id", "key").unionByName(tags)
    return raw.select("image_id", F.col("key").alias("raw_key"), X.meta_key(F.col("key")).alias("key"))


@query("meta_preview", "", """
    SELECT doc_id, CASE WHEN length(f) <= 200 THEN f ELSE rtrim(substr(f, 1, 200)) || '…' END AS preview
    FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v  　\u0085]+', ' ', 'g')) AS f FROM documents)
""")
def meta_preview(ev):
    return ev.table("documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


_FIRE = "firefly|midjourney|dall[·\\-\\s]?e|stable.?diffusion"
FINDINGS = f"""
norm AS MATERIALIZED (SELECT image_id, CASE WHEN starts_with(key, 'EXIF ') THEN substr(key, 6) WHEN starts_with(key, 'Image ') THEN substr(key, 7) ELSE key END AS key, value FROM fx_metadata),
finds AS MATERIALIZED (SELECT * FROM (SELECT *, CASE WHEN lower(key) = 'parameters' THEN 'Automatic1111' WHEN lower(key) IN ('prompt', 'workflow', 'workflow_json') THEN 'ComfyUI'
    WHEN key = 'XMP:xmp:CreatorTool' AND regexp_matches(value, '{_FIRE}|comfyui|invoke.?ai|novelai|leonardo\\.ai|ideogram|flux', 'i') THEN 'XMP AI Indicator'
    WHEN key = 'XMP:photoshop:Credit' AND regexp_matches(value, 'ai[- ]generated|made.?with.?ai', 'i') THEN 'XMP AI Indicator'
    WHEN key = 'XMP:dc:description' AND regexp_matches(value, '{_FIRE}', 'i') THEN 'XMP AI Indicator' END AS tool,
    CASE lower(key) WHEN 'prompt' THEN 'prompt' WHEN 'workflow' THEN 'workflow' WHEN 'workflow_json' THEN 'workflow' END AS kind
  FROM norm WHERE coalesce(value, '') <> '') WHERE tool IS NOT NULL)
"""


def _chunks(ev):
    return MD.normalize_keys(ev.metadata)


@query("ai_metadata_findings", "fx_metadata", "WITH " + FINDINGS + "SELECT image_id, tool, key, kind, value FROM finds")
def ai_metadata_findings(ev):
    return MD.findings(_chunks(ev)).drop("preview")


@query("ai_metadata_status", "fx_metadata", "WITH " + FINDINGS + """
    SELECT image_id, n AS finding_count, CASE WHEN n > 0 THEN 'FOUND' ELSE 'NOT FOUND' END AS status,
           CASE WHEN n > 0 THEN 'Found ' || n || ' AI metadata entr' || CASE WHEN n = 1 THEN 'y' ELSE 'ies' END || '.' ELSE 'No AI EXIF metadata detected.' END AS summary
    FROM (SELECT i.image_id, count(f.image_id) AS n FROM (SELECT DISTINCT image_id FROM fx_metadata) i LEFT JOIN finds f ON f.image_id = i.image_id GROUP BY i.image_id)
""")
def ai_metadata_status(ev):
    return MD.ai_metadata(ev.metadata.select("image_id").distinct(), _chunks(ev))


@query("sd_params_parse", "fx_metadata", """
    WITH p AS (SELECT image_id, key, CASE WHEN contains(value, 'Steps:') THEN rtrim(trim(substr(value, 1, strpos(value, 'Steps:') - 1)), ',') ELSE '' END AS prompt,
                      CASE WHEN contains(value, 'Steps:') THEN substr(value, strpos(value, 'Steps:')) ELSE trim(value) END AS blob FROM fx_metadata WHERE lower(key) = 'parameters'),
    parts AS (SELECT image_id, key, unnest(range(len(l))) AS i, trim(unnest(l)) AS part FROM (SELECT *, string_split(blob, ',') AS l FROM p)),
    kv AS (SELECT image_id, key, i, replace(lower(trim(substr(part, 1, strpos(part, ':') - 1))), ' ', '_') AS name, trim(substr(part, strpos(part, ':') + 1)) AS value FROM parts WHERE contains(part, ':')
           UNION ALL SELECT image_id, key, -1, 'prompt', prompt FROM p WHERE prompt <> '')
    SELECT image_id, key, name, arg_max(value, i) AS value FROM kv GROUP BY image_id, key, name
""")
def sd_params_parse(ev):
    return MD.sd_params(ev.metadata)


@query("workflow_json_parse", "fx_metadata", "WITH " + FINDINGS + """
    SELECT image_id, key, kind, starts_with(trim(value), '{') AND json_valid(value) AS parsed,
           CASE WHEN json_valid(value) THEN value::JSON ->> '$."1".class_type' END AS class_type
    FROM finds WHERE tool = 'ComfyUI'
""")
def workflow_json_parse(ev):
    out = MD.workflow_json(_chunks(ev))
    return out.select("image_id", "key", "kind", F.col("parsed_json").isNotNull().alias("parsed"),
                      F.try_variant_get("parsed_json", "$['1'].class_type", "string").alias("class_type"))


@query("friendly_metadata", "fx_metadata", "WITH " + FINDINGS + f"""
    SELECT image_id, ord, label, value FROM norm JOIN (VALUES {', '.join(f"(CAST({i} AS BIGINT), '{k}', '{t}')" for i, (k, t) in enumerate(MD.FRIENDLY_KEYS))}) t(ord, k, label) ON key = k
    WHERE coalesce(value, '') <> ''
""")
def friendly_metadata(ev):
    return MD.friendly(_chunks(ev))


@query("metadata_categories", "fx_metadata", "WITH " + FINDINGS + f"""
    SELECT image_id, list_position({list(MD.CATEGORIES)!r}, category)::BIGINT - 1 AS cat_ord, category, lower(key) AS sort_key, key, value FROM (
      SELECT *, CASE WHEN starts_with(key, 'GPS:') THEN 'GPS' WHEN starts_with(key, 'XMP:') THEN 'XMP' WHEN key IN {MD.BASIC_KEYS!r} THEN 'Basic'
                     WHEN key IN {MD.CAMERA_KEYS!r} THEN 'Camera' ELSE 'Other' END AS category FROM norm)
""")
def metadata_categories(ev):
    return MD.categories(_chunks(ev))
