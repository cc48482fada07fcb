"""Evidence tables derived from the generic test tables, in Spark and in DuckDB.

Every derivation keeps all rows of its source, so the evidence grows with the data. Where one text suits both
engines it is written once; ``FIXTURES.md`` documents the schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Derived tables whose rows are expensive to work on: their source is spread over the cores when it has few splits.
_HEAVY_ROWS = ("fx_manifest", "fx_data_url")

SOURCE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# name -> (dependencies, Spark SQL, DuckDB SQL); None as DuckDB SQL means the Spark text suits both.
_FX: dict[str, tuple[tuple[str, ...], str, str | None]] = {}


def _fx(name: str, deps: str, spark_sql: str, duck_sql: str | None = None) -> None:
    _FX[name] = (tuple(deps.split()), spark_sql, duck_sql)


_fx(
    "fx_submission",
    "embeddings",
    """
    SELECT 2 * vec_id + v AS image_id,
           lower(lpad(hex(p ^ if(v = 1, shiftleft(shiftleft(1L, CAST(vec_id % 8 AS INT)) - 1L,
                                                  CAST(vec_id % 48 AS INT)), 0L)), 16, '0')) AS phash,
           lower(lpad(hex(w ^ if(v = 1, shiftleft(shiftleft(1L, CAST(vec_id % 5 AS INT)) - 1L,
                                                  CAST(vec_id % 48 AS INT)), 0L)), 16, '0')) AS whash,
           timestamp_seconds(1704067200 + 3600 * (2 * vec_id + v)) AS created_at
    FROM (SELECT vec_id,
                 aggregate(sequence(0, 63), 0L,
                           (a, i) -> a | if(embedding[i] > 0, shiftleft(1L, i), 0L)) AS p,
                 aggregate(sequence(0, 63), 0L,
                           (a, i) -> a | if(embedding[63 - i] > 0, shiftleft(1L, i), 0L)) AS w,
                 explode(array(0, 1)) AS v
          FROM {embeddings})
    """,
    """
    SELECT 2 * vec_id + v AS image_id,
           lpad(lower(to_hex(xor(p, CASE WHEN v = 1 THEN
             ((((1::HUGEINT << (vec_id % 8)::INT) - 1) << (vec_id % 48)::INT))::UBIGINT ELSE 0::UBIGINT END))), 16, '0') AS phash,
           lpad(lower(to_hex(xor(w, CASE WHEN v = 1 THEN
             ((((1::HUGEINT << (vec_id % 5)::INT) - 1) << (vec_id % 48)::INT))::UBIGINT ELSE 0::UBIGINT END))), 16, '0') AS whash,
           TIMESTAMP '2024-01-01 00:00:00' + to_hours(2 * vec_id + v) AS created_at
    FROM (SELECT vec_id,
                 list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0
                   THEN (1::UBIGINT << i)::HUGEINT ELSE 0 END))::UBIGINT AS p,
                 list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[64 - i] > 0
                   THEN (1::UBIGINT << i)::HUGEINT ELSE 0 END))::UBIGINT AS w
          FROM embeddings), (VALUES (0), (1)) t(v)
    """,
)

_fx(
    "fx_registry",
    "fx_submission",
    """
    SELECT r.image_id AS image_id, phash, r.whash AS whash, r.created_at AS created_at
    FROM (SELECT phash, min_by(struct(image_id, whash, created_at), image_id) AS r
          FROM {fx_submission} GROUP BY phash)
    """,
    """
    SELECT min(image_id) AS image_id, phash, arg_min(whash, image_id) AS whash,
           arg_min(created_at, image_id) AS created_at
    FROM fx_submission GROUP BY phash
    """,
)

_fx(
    "fx_vote_event",
    "events",
    """
    SELECT event_id, CAST(ts AS TIMESTAMP) AS ts,
           CAST(get_json_object(props, '$.k') AS BIGINT) + 100 * (user_id DIV 15) AS image_id,
           sha2(CAST(user_id AS STRING) || ':fixture', 256) AS voter_id,
           CASE event_type WHEN 'view' THEN 'real' WHEN 'click' THEN 'edited' WHEN 'purchase' THEN 'ai'
                ELSE 'unsure' END AS choice
    FROM {events} WHERE event_type <> 'signup'
    """,
    """
    SELECT event_id, ts,
           CAST(json_extract_string(props, '$.k') AS BIGINT) + 100 * (user_id // 15) AS image_id,
           sha256(CAST(user_id AS VARCHAR) || ':fixture') AS voter_id,
           CASE event_type WHEN 'view' THEN 'real' WHEN 'click' THEN 'edited' WHEN 'purchase' THEN 'ai'
                ELSE 'unsure' END AS choice
    FROM events WHERE event_type <> 'signup'
    """,
)

_fx(
    "fx_report_event",
    "events",
    """
    SELECT event_id, CAST(ts AS TIMESTAMP) AS ts,
           CAST(get_json_object(props, '$.k') AS BIGINT) + 100 * (user_id DIV 15) AS image_id,
           sha2(CAST(user_id AS STRING) || ':fixture', 256) AS voter_id,
           CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 2 = 1 THEN ' OpenAI ' ELSE 'google' END AS provider,
           CASE WHEN event_id % 11 = 0 THEN 'mystery' WHEN event_id % 2 = 1 THEN 'OpenAI_Verify'
                ELSE 'google_about_this_image' END AS detector,
           CASE WHEN event_id % 3 = 0 THEN 'not_detected' WHEN event_id % 13 = 0 THEN 'maybe'
                ELSE 'detected' END AS result
    FROM {events} WHERE event_type = 'signup'
    """,
    """
    SELECT event_id, ts,
           CAST(json_extract_string(props, '$.k') AS BIGINT) + 100 * (user_id // 15) AS image_id,
           sha256(CAST(user_id AS VARCHAR) || ':fixture') AS voter_id,
           CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 2 = 1 THEN ' OpenAI ' ELSE 'google' END AS provider,
           CASE WHEN event_id % 11 = 0 THEN 'mystery' WHEN event_id % 2 = 1 THEN 'OpenAI_Verify'
                ELSE 'google_about_this_image' END AS detector,
           CASE WHEN event_id % 3 = 0 THEN 'not_detected' WHEN event_id % 13 = 0 THEN 'maybe'
                ELSE 'detected' END AS result
    FROM events WHERE event_type = 'signup'
    """,
)

_fx(
    "fx_report_old",
    "events",
    """
    SELECT event_id AS id, user_id AS image_id, CAST(event_id % 4 AS STRING) AS voter_id,
           CASE WHEN event_id % 3 = 0 THEN 'google' END AS provider,
           CASE WHEN event_id % 5 <> 0 THEN 'openai_verify' END AS detector,
           CASE WHEN event_id % 2 = 0 THEN 'api' END AS source_kind
    FROM {events}
    """,
)

_fx(
    "fx_source",
    "pages",
    """
    SELECT CAST(floor(page_id / 5) AS BIGINT) AS image_id, url FROM {pages}
    UNION ALL
    SELECT CAST(floor(page_id / 3) AS BIGINT) AS image_id,
           'https://i.redd.it/' || lpad(CAST(page_id AS STRING), 13, '0') || '.jpg' AS url FROM {pages}
    UNION ALL
    SELECT CAST(floor(page_id / 4) AS BIGINT) AS image_id,
           'https://pbs.twimg.com/media/m' || CAST(page_id AS STRING) || '?format=png&name=orig' AS url FROM {pages}
    """,
)

_fx(
    "fx_lookup_input",
    "pages",
    """
    SELECT 4 * page_id AS pos, url FROM {pages}
    UNION ALL
    SELECT 4 * page_id + 1 AS pos, 'https://preview.redd.it/img-' || lpad(CAST(page_id AS STRING), 13, '0')
           || '.jpg?width=640&auto=webp' AS url FROM {pages}
    UNION ALL
    SELECT 4 * page_id + 2 AS pos, 'https://pbs.twimg.com/media/m' || CAST(page_id AS STRING) ||
           CASE WHEN page_id % 3 = 0 THEN '?format=png&name=small' WHEN page_id % 3 = 1 THEN '?name=medium'
                ELSE '?format=png&name=orig' END AS url FROM {pages}
    UNION ALL
    SELECT 4 * page_id + 3 AS pos, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://nowhere.example/' || url END AS url
    FROM {pages}
    """,
)

_fx(
    "fx_fact",
    "labels documents",
    """
    SELECT CAST(floor(l.doc_id / 2) AS BIGINT) AS image_id,
           CASE WHEN l.quality = 1 THEN 'c2pa' ELSE 'exif' END AS analyzer, 'Signed by ' || d.source AS data
    FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
    """,
)

_fx(
    "fx_link_event",
    "customer",
    """
    SELECT c_custkey AS link_id, CAST(floor(c_custkey / 2) AS BIGINT) AS parent_id, c_custkey AS child_id,
           CAST(c_custkey % 4 AS DOUBLE) / 10 AS l, CAST(c_custkey % 3 AS DOUBLE) / 10 AS t,
           CAST(0.5 AS DOUBLE) AS w, CAST(0.25 AS DOUBLE) + CAST(c_custkey % 2 AS DOUBLE) / 4 AS h
    FROM {customer} WHERE c_custkey > 1
    UNION ALL
    SELECT 1000000 - c_custkey AS link_id, CAST(floor(c_custkey / 2) AS BIGINT) AS parent_id,
           CASE WHEN c_custkey % 5 = 0 THEN CAST(floor(c_custkey / 2) AS BIGINT) ELSE c_custkey * 3 END AS child_id,
           CAST(0.25 AS DOUBLE) AS l, CAST(0 AS DOUBLE) AS t, CAST(0.75 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS h
    FROM {customer} WHERE c_custkey > 1
    """,
)

_fx(
    "fx_web_match",
    "pages",
    """
    SELECT CAST(floor(page_id / 12) AS BIGINT) AS image_id, page_id AS ord,
           CASE WHEN page_id % 6 = 1 THEN 'https://cdn.civitai.com/images/' || CAST(page_id AS STRING)
                WHEN page_id % 6 = 2 THEN 'https://civitai.com/p?q=' || CAST(page_id AS STRING)
                ELSE url END AS url,
           CASE WHEN page_id % 5 = 0 THEN ''
                WHEN page_id % 7 = 1 THEN ' WWW.Civitai.com '
                WHEN page_id % 7 = 2 THEN 'old.reddit.com'
                WHEN page_id % 7 = 3 THEN 'stock.adobe.com'
                WHEN page_id % 7 = 4 THEN 'daily-news' || CAST(page_id % 3 AS STRING) || '.org'
                ELSE 'x.com' END AS domain,
           CASE WHEN page_id % 11 = 0 THEN ''
                ELSE CAST(CAST(date_add(CAST('2017-01-01' AS DATE), CAST(page_id * 13 % 3650 AS INT)) AS DATE) AS STRING)
                     || 'T00:00:00' END AS crawl_date,
           CAST(60 + page_id * 37 % 41 AS DOUBLE) / 100 AS similarity
    FROM {pages}
    """,
    """
    SELECT CAST(floor(page_id / 12) AS BIGINT) AS image_id, page_id AS ord,
           CASE WHEN page_id % 6 = 1 THEN 'https://cdn.civitai.com/images/' || CAST(page_id AS STRING)
                WHEN page_id % 6 = 2 THEN 'https://civitai.com/p?q=' || CAST(page_id AS STRING)
                ELSE url END AS url,
           CASE WHEN page_id % 5 = 0 THEN ''
                WHEN page_id % 7 = 1 THEN ' WWW.Civitai.com '
                WHEN page_id % 7 = 2 THEN 'old.reddit.com'
                WHEN page_id % 7 = 3 THEN 'stock.adobe.com'
                WHEN page_id % 7 = 4 THEN 'daily-news' || CAST(page_id % 3 AS STRING) || '.org'
                ELSE 'x.com' END AS domain,
           CASE WHEN page_id % 11 = 0 THEN ''
                ELSE CAST(DATE '2017-01-01' + CAST(page_id * 13 % 3650 AS INT) AS STRING) || 'T00:00:00' END AS crawl_date,
           CAST(60 + page_id * 37 % 41 AS DOUBLE) / 100 AS similarity
    FROM pages
    """,
)

_fx(
    "fx_local_match",
    "embeddings",
    """
    SELECT 2 * vec_id AS query_id, 2 * vec_id + 1 AS neighbor_id, 'orb' AS extractor,
           40 + vec_id % 60 AS good_matches, 16 + vec_id % 24 AS inliers,
           CAST(16 + vec_id % 24 AS DOUBLE) / (40 + vec_id % 60) AS inlier_ratio
    FROM {embeddings}
    """,
)

_fx(
    "fx_keypoint",
    "fx_submission",
    """
    SELECT 2 * CAST(floor(image_id / 80) AS BIGINT) + image_id % 2 AS image_id,
           CAST(floor(image_id / 2) AS BIGINT) % 40 AS kp_idx,
           phash AS d0, whash AS d1, reverse(phash) AS d2, reverse(whash) AS d3,
           CAST(image_id * 37 % 640 AS DOUBLE) AS x, CAST(image_id * 91 % 480 AS DOUBLE) AS y
    FROM {fx_submission}
    """,
)

# Images in pairs of an original and a smaller copy: 64 keypoints each, 32 of 256 bits of a descriptor differ, an eighth of
# the copy's keypoints lie elsewhere, and in every fifth pair all of them do.
_fx(
    "fx_copy_keypoint",
    "customer",
    """
    SELECT image_id, kp_idx, side,
           CASE WHEN side = 1 AND kp_idx % 3 = 0 THEN translate(d0, '0123456789abcdef', '1032547698badcfe') ELSE d0 END AS d0,
           CASE WHEN side = 1 AND kp_idx % 3 < 2 THEN translate(d1, '0123456789abcdef', '1032547698badcfe') ELSE d1 END AS d1,
           CASE WHEN side = 1 AND kp_idx % 3 > 0 THEN translate(d2, '0123456789abcdef', '1032547698badcfe') ELSE d2 END AS d2,
           CASE WHEN side = 1 AND kp_idx % 3 = 2 THEN translate(d3, '0123456789abcdef', '1032547698badcfe') ELSE d3 END AS d3,
           CASE WHEN side = 0 THEN x WHEN pair_no % 5 = 4 THEN CAST(c_custkey * 5477 * kp_idx % 600 AS DOUBLE)
                ELSE x / 2 + 40 + CASE WHEN kp_idx % 8 = 3 THEN 90 ELSE 0 END END AS x,
           CASE WHEN side = 0 THEN y WHEN pair_no % 5 = 4 THEN CAST(c_custkey * 3331 * (kp_idx + 7) % 440 AS DOUBLE)
                ELSE y / 2 + 30 + CASE WHEN kp_idx % 8 = 3 THEN kp_idx ELSE 0 END END AS y
    FROM (SELECT c_custkey, side, pair_no, kp_idx, 2 * pair_no + side AS image_id,
                 substr(a, 1, 16) AS d0, substr(a, 17) AS d1, substr(b, 1, 16) AS d2, substr(b, 17) AS d3,
                 CAST(c_custkey * 37 % 600 AS DOUBLE) AS x, CAST(c_custkey * 91 % 440 AS DOUBLE) AS y
          FROM (SELECT c_custkey, CAST(floor((c_custkey - 1) / 64) AS BIGINT) AS pair_no, (c_custkey - 1) % 64 AS kp_idx,
                       md5(CONCAT('a', CAST(c_custkey AS STRING))) AS a, md5(CONCAT('b', CAST(c_custkey AS STRING))) AS b
                FROM {customer}) k
          CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1 AS side) s) w
    """,
)

_fx(
    "fx_image_features",
    "fx_keypoint",
    """
    SELECT image_id, CAST(CASE WHEN image_id % 2 = 0 THEN 640 ELSE 650 END AS BIGINT) AS width,
           CAST(CASE WHEN image_id % 14 = 13 THEN 0 ELSE 480 END AS BIGINT) AS height,
           COUNT(*) AS keypoint_count
    FROM {fx_keypoint} GROUP BY image_id
    """,
)

_fx(
    "fx_feature_row",
    "part",
    """
    SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS image_id,
           CASE WHEN p_partkey % 2 = 0 THEN 'orb' WHEN p_partkey % 17 = 0 THEN 'sift' ELSE 'akaze' END AS extractor,
           CASE WHEN p_partkey % 13 = 0 THEN 2 ELSE 1 END AS feature_version,
           CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 640 END AS width, 480 AS height,
           p_partkey * 53 % 300 AS keypoint_count
    FROM {part}
    """,
)

_fx(
    "fx_request",
    "events",
    "SELECT event_id, user_id AS key, CAST(ts AS TIMESTAMP) AS ts FROM {events}",
)

_fx(
    "fx_metadata",
    "documents",
    """
    SELECT CAST(floor(doc_id / 3) AS BIGINT) AS image_id,
           CASE doc_id % 11 WHEN 0 THEN 'parameters' WHEN 1 THEN 'prompt' WHEN 2 THEN 'Workflow'
                WHEN 3 THEN 'XMP:xmp:CreatorTool' WHEN 4 THEN 'EXIF Software' WHEN 5 THEN 'Make' WHEN 6 THEN 'Comment'
                WHEN 7 THEN 'GPS:Latitude' WHEN 8 THEN 'XMP:dc:description' WHEN 9 THEN 'FileType'
                ELSE 'Image Model' END AS key,
           CASE doc_id % 11
                WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'a photo of ' || source || ',, Steps: 20, Sampler: Euler a, CFG scale: 7, Sampler: DDIM, odd'
                                 ELSE 'CFG scale: 5, Seed: ' || CAST(doc_id AS STRING) || ', broken' END
                WHEN 1 THEN '{"1": {"class_type": "' || source || '"}}'
                WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'not json ' || source ELSE '{"broken": ' || source END
                WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'Adobe Firefly 2' ELSE 'Paint' END
                WHEN 6 THEN text
                WHEN 8 THEN CASE WHEN doc_id % 2 = 0 THEN 'made with DALL-E 3' ELSE text END
                WHEN 9 THEN CASE WHEN doc_id % 2 = 0 THEN 'PNG' ELSE '' END
                ELSE source END AS value
    FROM {documents}
    """,
)

_fx(
    "fx_manifest",
    "orders",
    """
    SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 23 = 5 THEN '{"manifests":{},"active_manifest":"m1"}'
      WHEN o_orderkey % 23 = 6 THEN '{broken'
      ELSE '{"active_manifest":"m1","validation_status":["'
      || CASE o_orderstatus WHEN 'F' THEN 'claimSignature.validated' WHEN 'O' THEN 'signingCredential.untrusted'
                            ELSE 'signingCredential.trusted' END || '"'
      || CASE WHEN o_orderkey % 9 = 0 THEN ',{"code":"timeStamp.trusted"}' WHEN o_orderkey % 9 = 1 THEN ',"timeStamp.untrusted"'
              WHEN o_orderkey % 9 = 2 THEN ',"signingCredential.expired"' WHEN o_orderkey % 9 = 3 THEN ',{"status":" signingCredential.Revoked "}'
              ELSE '' END
      || '],"manifests":{"m0":{"title":"old"},"m1":{"title":"order ' || CAST(o_orderkey AS STRING) || '","format":"image/jpeg",'
      || '"signature_info":{' || CASE WHEN o_orderkey % 10 = 4 THEN '' ELSE '"issuer":"' || o_orderpriority || '",' END || '"alg":"es256"'
      || CASE WHEN o_orderkey % 2 = 0 THEN ',"time":"2026-01-02T03:04:05Z"' ELSE '' END || '},'
      || CASE WHEN o_orderkey % 20 = 4 THEN '' ELSE '"claim_generator":"tool ' || CAST(o_orderkey % 3 AS STRING) || '",' END
      || '"claim_generator_info":[{"name":"imagen","version":"3.' || CAST(o_orderkey % 4 AS STRING) || '"},{"identifier":"lib"},{}],'
      || CASE WHEN o_orderkey % 8 = 1 THEN '"validation_results":{"activeManifest":{"success":[{"code":"claimSignature.validated"}],"failure":[]}},'
              WHEN o_orderkey % 8 = 2 THEN '"validation_results":{"activeManifest":{"success":[],"failure":[{"code":"assertion.hashMismatch"}]}},'
              ELSE '' END
      || '"assertions":[{"label":"c2pa.actions.v2","data":{"actions":[{"action":"'
      || CASE o_orderkey % 4 WHEN 0 THEN 'c2pa.created' WHEN 1 THEN 'c2pa.opened' WHEN 2 THEN 'c2pa.color_adjustments' ELSE 'acme.do-it' END
      || '",' || CASE WHEN o_orderkey % 5 = 0 THEN '"parameters":{"digitalSourceType":"http://example.org/'
                      ELSE '"digitalSourceType":"http://example.org/' END
      || CASE o_orderkey % 4 WHEN 0 THEN 'trainedAlgorithmicMedia' WHEN 1 THEN 'digitalCapture' WHEN 2 THEN 'composite' ELSE 'computational-Capture' END
      || CASE WHEN o_orderkey % 5 = 0 THEN '"}' ELSE '"' END
      || CASE WHEN o_orderkey % 3 = 0 THEN ',"softwareAgent":{"name":"Imagen","version":"3.0"}'
              WHEN o_orderkey % 3 = 1 THEN ',"softwareAgent":" Photo Tool "' ELSE '' END || '},{"action":"c2pa.edited"'
      || CASE WHEN o_orderkey % 6 = 1 THEN ',"digitalSourceType":"compositeWithTrainedAlgorithmicMedia"' ELSE '' END
      || '}]}},{"label":"stds.exif","data":{"make":"'
      || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Google' END || '","Model":"Pixel ' || CAST(o_orderkey % 9 AS STRING)
      || '"}},{"url":"c2pa.exif","data":{"Make":"Late","Software":"Cam"}}],'
      || '"ingredients":[' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '{"title":"base","relationship":"parentOf","format":"","validation_status":["'
      || CASE WHEN o_orderkey % 12 = 1 THEN 'assertion.dataHash.mismatch' ELSE 'claimSignature.validated' END || '"]}' END
      || CASE WHEN o_orderkey % 12 = 3 THEN ',{"title":"second"}' ELSE '' END || ']}}}' END AS manifest_json
    FROM {orders}
    """,
)

_fx(
    "fx_payment",
    "orders",
    """
    SELECT o_orderkey AS payment_id,
           CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'ten'
                WHEN o_orderkey % 13 = 0 THEN '-5.00' WHEN o_orderkey % 11 = 0 THEN '10.005'
                ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) END AS amount
    FROM {orders}
    """,
)

_fx(
    "fx_crop_pixel",
    "lineitem",
    """
    SELECT l_orderkey AS crop_id, CAST(CASE WHEN l_orderkey % 3 = 0 THEN 100 WHEN l_orderkey % 3 = 1
             THEN 90 + l_partkey % 8 ELSE l_partkey % 256 END AS BIGINT) AS value
    FROM {lineitem}
    """,
)

_fx(
    "fx_luma_row",
    "embeddings",
    """
    SELECT CAST(floor(vec_id / 50) AS BIGINT) AS image_id, vec_id % 50 AS y,
           transform(embedding, v -> CASE
             WHEN floor(vec_id / 50) % 3 = 0 AND vec_id % 50 >= 36 THEN 20
             WHEN floor(vec_id / 50) % 3 = 1 AND vec_id % 50 < 10 THEN 240
             WHEN v > 0 THEN 102 ELSE 100 END) AS px
    FROM {embeddings}
    """,
    """
    SELECT CAST(floor(vec_id / 50) AS BIGINT) AS image_id, vec_id % 50 AS y,
           list_transform(embedding, lambda v: CASE
             WHEN floor(vec_id / 50) % 3 = 0 AND vec_id % 50 >= 36 THEN 20
             WHEN floor(vec_id / 50) % 3 = 1 AND vec_id % 50 < 10 THEN 240
             WHEN v > 0 THEN 102 ELSE 100 END) AS px
    FROM embeddings
    """,
)

_fx(
    "fx_fetch_log",
    "pages",
    """
    SELECT CASE WHEN page_id % 29 = 3 THEN 'ftp://files.example/' || CAST(page_id AS STRING) ELSE url END AS url,
           CASE WHEN page_id % 5 = 1 THEN 404 WHEN page_id % 31 = 7 THEN NULL ELSE 200 END AS status,
           CASE WHEN page_id % 7 = 2 THEN 'text/html' WHEN page_id % 37 = 9 THEN NULL ELSE 'image/png' END AS content_type,
           CASE WHEN page_id % 9 = 4 THEN '99999999' WHEN page_id % 9 = 5 THEN 'abc' WHEN page_id % 9 = 6 THEN NULL
                ELSE CAST(length(html) AS STRING) END AS declared_length,
           CAST(length(html) AS BIGINT) * CASE WHEN page_id % 41 = 12 THEN 100000 ELSE 1 END AS actual_length
    FROM {pages}
    """,
)

_fx(
    "fx_blocklist_line",
    "pages",
    """
    SELECT page_id AS line_no,
           CASE WHEN page_id % 50 = 0 THEN '# comment' WHEN page_id % 50 = 1 THEN '   '
                WHEN page_id % 50 = 2 THEN ' *://*.civitai.com/* '
                WHEN page_id % 50 = 3 THEN '/CIVITAI.COM.p/i'
                WHEN page_id % 50 = 4 THEN '/example[.]org.en/'
                WHEN page_id % 50 = 5 THEN 'plain text'
                WHEN page_id % 50 = 6 THEN '/[invalid(regex/'
                WHEN page_id % 50 = 7 THEN '/unclosed'
                WHEN page_id % 2 = 0 THEN '*://*.site' || CAST(page_id AS STRING) || '.example.net/*'
                ELSE '*/page-' || CAST(page_id AS STRING) || '?*' END AS line
    FROM {pages}
    """,
)

_fx(
    "fx_url_line",
    "pages",
    """
    SELECT page_id AS batch_no_key, CAST(floor(page_id / 8) AS BIGINT) AS batch_id, page_id AS pos,
           CASE WHEN page_id % 8 = 3 THEN '  ' WHEN page_id % 8 = 5 THEN 'not-a-url ' || url
                WHEN page_id % 8 = 6 THEN ' http://dup.example/a ' WHEN page_id % 8 = 7 THEN 'http://dup.example/a'
                ELSE '  ' || url || ' ' END AS line
    FROM {pages}
    UNION ALL
    SELECT page_id AS batch_no_key, CAST(floor(page_id / 32) AS BIGINT) AS batch_id, page_id + 1000000 AS pos, url AS line
    FROM {pages}
    """,
)

_fx(
    "fx_analyzer_row",
    "orders",
    """
    SELECT CAST(floor(o_orderkey / 4) AS BIGINT) AS analysis_id,
           CASE o_orderkey % 5 WHEN 0 THEN 'c2pa' WHEN 1 THEN 'synthid' WHEN 2 THEN 'tineye' WHEN 3 THEN 'exif' ELSE 'human' END AS slug,
           o_orderkey AS seq,
           CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 13 = 1 THEN 'manual' WHEN o_orderkey % 13 = 2 THEN 'loading'
                WHEN o_orderkey % 13 < 5 THEN 'NOT FOUND' WHEN o_orderkey % 13 = 5 THEN 'Detected' WHEN o_orderkey % 13 = 6 THEN 'SIMILAR' WHEN o_orderkey % 13 = 7 THEN 'FOUND' ELSE 'CHECKED' END AS status,
           CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'summary ' || o_orderpriority END AS summary,
           CASE WHEN o_orderkey % 6 = 0 THEN '[1]' ELSE '{"k":1}' END AS data,
           CASE WHEN o_orderkey % 2 = 0 THEN 'derived' ELSE 'none' END AS mode
    FROM {orders}
    """,
)


_fx(
    "fx_response",
    "pages",
    """
    SELECT page_id AS image_id,
           CASE WHEN page_id % 12 = 5 THEN '{"code":429,"messages":["Too many requests","slow down"]}'
                WHEN page_id % 12 = 7 THEN '{"code":500}'
                ELSE '{"code":200,"results":{"total_results":' || CAST(page_id % 5 + 2 AS STRING) || ',"matches":[{"score":'
                  || CAST(60 + page_id * 37 % 41 AS STRING) || ',"domain":"d' || CAST(page_id % 9 AS STRING) || '.org","backlinks":[{'
                  || CASE WHEN page_id % 3 = 0 THEN '"url":""' ELSE '"url":"' || url || '"' END
                  || ',"backlink":"http://back.example/' || CAST(page_id AS STRING) || '","crawl_date":"'
                  || CASE WHEN page_id % 4 = 1 THEN '2021-05-' || lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0')
                          WHEN page_id % 4 = 2 THEN 'spring 2020' ELSE '' END
                  || '"},{"url":"http://second.example"}]},{"score":81}]}}' END AS response_json
    FROM {pages}
    """,
)

_fx(
    "fx_data_url",
    "pages",
    """
    SELECT page_id, CASE page_id % 8
             WHEN 0 THEN 'data:image/png;base64,' || b WHEN 1 THEN 'data:;base64,' || b
             WHEN 2 THEN 'data:image/svg+xml;charset=utf-8,%3Csvg%20a+b' || CAST(page_id AS STRING) || '%3E'
             WHEN 3 THEN 'data:image/gif;BASE64,' || b WHEN 4 THEN 'data:nothing' || CAST(page_id AS STRING)
             WHEN 5 THEN 'data:image/png;base64,' || b || '!' WHEN 6 THEN 'data:image/png;base64,' || b || '?cut#off'
             ELSE 'data:,plain' || CAST(page_id AS STRING) END AS url
    FROM (SELECT page_id, regexp_replace(base64(CAST(html AS BINARY)), '[\\r\\n]', '') AS b FROM {pages})
    """,
    """
    SELECT page_id, CASE page_id % 8
             WHEN 0 THEN 'data:image/png;base64,' || b WHEN 1 THEN 'data:;base64,' || b
             WHEN 2 THEN 'data:image/svg+xml;charset=utf-8,%3Csvg%20a+b' || CAST(page_id AS STRING) || '%3E'
             WHEN 3 THEN 'data:image/gif;BASE64,' || b WHEN 4 THEN 'data:nothing' || CAST(page_id AS STRING)
             WHEN 5 THEN 'data:image/png;base64,' || b || '!' WHEN 6 THEN 'data:image/png;base64,' || b || '?cut#off'
             ELSE 'data:,plain' || CAST(page_id AS STRING) END AS url
    FROM (SELECT page_id, base64(encode(html)) AS b FROM pages)
    """,
)


def dependencies(names: str | list[str]) -> list[str]:
    """The named derived tables and everything derived they rest on, in build order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in SOURCE_TABLES or name in order:
            return
        for dep in _FX[name][0]:
            visit(dep)
        order.append(name)

    for name in names.split() if isinstance(names, str) else names:
        visit(name)
    return order


def duck_with(names: str, body: str) -> str:
    """``body`` as DuckDB SQL with the named derived tables as common table expressions in front."""
    ctes = []
    for name in dependencies(names):
        deps, spark_sql, duck_sql = _FX[name]
        text = duck_sql if duck_sql is not None else _fill(spark_sql, deps)
        ctes.append(f"{name} AS MATERIALIZED ({text})")
    if not ctes:
        return body
    head = "WITH RECURSIVE " if body.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    stripped = body.lstrip()
    if stripped.upper().startswith("WITH "):
        rest = stripped[len("WITH RECURSIVE "):] if head != "WITH " else stripped[len("WITH "):]
        return head + ",\n".join(ctes) + ",\n" + rest
    return head + ",\n".join(ctes) + "\n" + body


def _fill(text: str, deps: tuple[str, ...]) -> str:
    for dep in deps:
        text = text.replace("{" + dep + "}", dep)
    return text


class Evidence:
    """The derived evidence tables of one data folder as lazily built DataFrames: ``ev.submission`` etc."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _get(self, name: str) -> DataFrame:
        if name in SOURCE_TABLES:
            return self.table(name)
        if name not in self._built:
            deps, text, _ = _FX[name]
            # The derivations hold JSON braces, so inputs are bound through views with one-off names.
            for dep in deps:
                view = f"pv_{dep}_{id(self):x}"
                source = self._get(dep)
                if name in _HEAVY_ROWS:  # heavy for each row, and single-file inputs come in few splits
                    view, source = f"{view}_spread", source.repartition(self.spark.sparkContext.defaultParallelism)
                source.createOrReplaceTempView(view)
                text = text.replace("{" + dep + "}", view)
            self._built[name] = self.spark.sql(text)
        return self._built[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._get(f"fx_{name}")
