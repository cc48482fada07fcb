"""Registered queries: URLs, crawl logs, lookup, back-links, block lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from provspark.functions import texts as X
from provspark.functions import urls as U
from provspark.operators import backlinks as BL
from provspark.operators import blocklist as BK
from provspark.operators import lookup as LK
from provspark.plans.catalog import query
from provspark.plans.queries_community import VERDICT, verdicts_of
from provspark.sources import payloads as P
from provspark.sources import text_lists as TL

# Oracle text of the full-resolution rule over a column.
def _full_res(url: str) -> str:
    reddit = ("regexp_extract({0}, 'https?://(?:preview|external-preview)[.]redd[.]it/([a-zA-Z0-9_-]+[.](?:jpe?g|png|gif|webp))', 1)"
              .format(url))
    media = f"regexp_extract({url}, '(https?://pbs[.]twimg[.]com/media/[^?]+)', 1)"
    fmt = f"coalesce(nullif(regexp_extract({url}, 'format=([a-z]+)', 1), ''), 'jpg')"
    return f"""coalesce(
      nullif(CASE WHEN {reddit} <> '' THEN 'https://i.redd.it/' || right(regexp_extract({reddit}, '^(.*)[.]([^.]*)$', 1), 13) || '.'
                  || regexp_extract({reddit}, '^(.*)[.]([^.]*)$', 2) END, {url}),
      nullif(CASE WHEN contains({url}, 'pbs.twimg.com/media/') AND {media} <> '' THEN {media} || '?format=' || {fmt} || '&name=orig' END, {url}))"""


@query("url_full_res", "fx_lookup_input", f"SELECT pos, url, {_full_res('url')} AS full_res_url FROM fx_lookup_input")
def url_full_res(ev):
    return ev.lookup_input.select("pos", "url", U.full_res(F.col("url")).alias("full_res_url"))


@query("url_display", "fx_lookup_input", """
    SELECT pos, CASE WHEN u = '' THEN NULL WHEN host = '' THEN u WHEN path = '' THEN host
                     ELSE host || '/' || substr(path, 1, 20) || CASE WHEN length(path) > 20 THEN '...' ELSE '' END END AS display
    FROM (SELECT *, regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host,
                 ltrim(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS path
          FROM (SELECT pos, CASE pos % 7 WHEN 0 THEN 'no scheme ' || url WHEN 1 THEN '' WHEN 2 THEN 'http://u:p@host' || pos || ':80' ELSE url END AS u
                FROM fx_lookup_input))
""")
def url_display(ev):
    m = F.col("pos") % 7
    u = (
        F.when(m == 0, F.concat(F.lit("no scheme "), "url")).when(m == 1, "")
        .when(m == 2, F.concat(F.lit("http://u:p@host"), "pos", F.lit(":80"))).otherwise(F.col("url"))
    )
    return ev.lookup_input.select("pos", U.display(u).alias("display"))


@query("search_links", "fx_lookup_input", """
    SELECT pos, label, CASE WHEN u IS NULL THEN fallback ELSE prefix || replace(url_encode(u), '%20', '+') END AS link
    FROM (SELECT pos, CASE WHEN pos % 6 <> 0 THEN url || ' x*~é' END AS u FROM fx_lookup_input),
         (VALUES ('Google', 'https://lens.google.com/upload?url=', 'https://images.google.com/'),
                 ('Bing', 'https://www.bing.com/images/search?view=detailv2&iss=sbi&form=SBIHMP&q=imgurl:', 'https://www.bing.com/visualsearch'),
                 ('TinEye', 'https://tineye.com/search?url=', NULL)) t(label, prefix, fallback)
    WHERE u IS NOT NULL OR fallback IS NOT NULL
""")
def search_links(ev):
    u = F.when(F.col("pos") % 6 != 0, F.concat("url", F.lit(" x*~é")))
    return ev.lookup_input.select("pos", F.explode(U.search_links(u)).alias("l")).select(
        "pos", "l.label", F.col("l.url").alias("link")
    )


@query("data_url_decode", "fx_data_url", r"""
    SELECT page_id, CASE WHEN error IS NULL THEN media END AS media_type,
           CASE WHEN error IS NULL THEN to_hex(content) END AS content_hex, error
    FROM (SELECT *, CASE WHEN cut = 0 THEN 'Invalid data URL.' WHEN is64 AND NOT strict THEN 'Invalid base64 data URL.' END AS error,
                 CASE WHEN is64 AND strict THEN from_base64(payload) WHEN NOT is64 AND cut > 0 THEN encode(url_decode(payload)) END AS content
          FROM (SELECT *, strpos(path, ',') AS cut,
                       coalesce(CASE WHEN segs[1] <> '' THEN segs[1] END, 'application/octet-stream') AS media,
                       len(list_filter(segs[2:], lambda s: lower(s) = 'base64')) > 0 AS is64,
                       regexp_full_match(payload, '[A-Za-z0-9+/]*={0,2}') AND length(payload) % 4 = 0 AS strict
                FROM (SELECT page_id, path, substr(path, strpos(path, ',') + 1) AS payload,
                             list_filter(string_split(substr(path, 1, greatest(strpos(path, ',') - 1, 0)), ';'), lambda s: s <> '') AS segs
                      FROM (SELECT page_id, regexp_extract(url, '^data:([^?#]*)', 1) AS path FROM fx_data_url))))
""")
def data_url_decode(ev):
    parts = U.data_url_parts(F.col("url"))
    return ev.data_url.select(
        "page_id", parts["media_type"].alias("media_type"), F.hex(parts["content"]).alias("content_hex"),
        parts["error"].alias("error"),
    )


@query("data_url_encode", "", "SELECT page_id, 'data:text/html;base64,' || base64(encode(html)) AS data_url FROM pages")
def data_url_encode(ev):
    return ev.table("pages").select(
        "page_id", U.data_url_encode(F.lit("text/html"), F.col("html").cast("binary")).alias("data_url")
    )


_HEADS = ("FFD8FFE0", "89504E470D0A1A0A", "474946383761", "474946383961", "524946460000000057454250", "524946460000000041564920",
          "000000206674797061766966", "000000206674797068656963", "0000002066747970")


@query("payload_type", "", f"""
    SELECT page_id, CASE WHEN starts_with(h, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(h, '89504E470D0A1A0A') THEN 'image/png'
                         WHEN starts_with(h, '474946383761') OR starts_with(h, '474946383961') THEN 'image/gif'
                         WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'image/webp'
                         WHEN substr(h, 9, 8) = '66747970' AND substr(h, 17, 8) IN ('61766966', '61766973', '61763031', '6D696631', '6D736631') THEN 'image/avif'
                         ELSE 'application/octet-stream' END AS media_type
    FROM (SELECT page_id, CASE page_id % 10 {' '.join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADS))} ELSE '' END || to_hex(encode(html)) AS h FROM pages)
""")
def payload_type(ev):
    m = F.col("page_id") % 10
    head = F.when(m == 0, _HEADS[0])
    for i, h in enumerate(_HEADS[1:], start=1):
        head = head.when(m == i, h)
    content = F.concat(F.unhex(head.otherwise("")), F.col("html").cast("binary"))
    return ev.table("pages").select("page_id", P.media_type(content).alias("media_type"))


TRIAGED = """
triaged AS (SELECT *, CASE WHEN NOT regexp_matches(lower(url), '^https?:') THEN 'Only HTTP/HTTPS URLs are supported.'
      WHEN status IS NULL THEN 'Failed to download image from URL.'
      WHEN status <> 200 THEN 'Image URL returned a non-200 status code.'
      WHEN NOT contains(coalesce(content_type, ''), 'image') THEN 'URL does not point to an image.' END AS error FROM fx_fetch_log)
"""


@query("fetch_log_triage", "fx_fetch_log", "WITH " + TRIAGED + """
    SELECT url, CAST(status AS BIGINT) AS status, content_type, declared_length, actual_length, error FROM triaged
""")
def fetch_log_triage(ev):
    return LK.triage(ev.fetch_log).withColumn("status", F.col("status").cast("bigint"))


@query("prefer_full_res", "fx_fetch_log fx_lookup_input", "WITH " + TRIAGED + f""",
    log AS (SELECT url, error FROM triaged UNION ALL
            SELECT u, CASE WHEN length(u) % 3 = 0 THEN 'Image URL returned a non-200 status code.' END
            FROM (SELECT DISTINCT {_full_res('url')} AS u FROM fx_lookup_input) WHERE u IS NOT NULL),
    ins AS (SELECT DISTINCT url, {_full_res('url')} AS full_res_url FROM fx_lookup_input),
    j AS (SELECT i.*, f.url IS NOT NULL AND f.error IS NULL AS upgraded, p.url IS NOT NULL AND p.error IS NULL AS fetched, p.error AS pe
          FROM ins i LEFT JOIN log f ON i.full_res_url = f.url LEFT JOIN log p ON i.url = p.url)
    SELECT url, full_res_url, upgraded, CASE WHEN upgraded THEN full_res_url WHEN fetched THEN url END AS fetch_url,
           CASE WHEN NOT upgraded AND NOT fetched THEN coalesce(pe, 'Failed to download image from URL.') END AS error
    FROM j
""")
def prefer_full_res(ev):
    log = LK.triage(ev.fetch_log).select("url", "error")
    variants = ev.lookup_input.select(U.full_res(F.col("url")).alias("url")).filter("url is not null").distinct()
    extra = variants.withColumn("error", F.when(F.length("url") % 3 == 0, "Image URL returned a non-200 status code."))
    return LK.prefer_full_res(ev.lookup_input, log.unionByName(extra))


@query("url_list_source", "fx_url_line", """
    WITH rows_ AS (SELECT batch_id, pos, trim(line) AS url FROM fx_url_line WHERE trim(line) <> ''),
    fits AS (SELECT * FROM rows_)
    SELECT batch_id, min(pos) AS pos, url, NULL AS error, NULL AS label FROM fits WHERE url LIKE 'http://%' OR url LIKE 'https://%' GROUP BY batch_id, url
    UNION ALL
    SELECT batch_id, pos, url, 'Invalid URL format', substr(url, 1, 60) FROM fits WHERE NOT (url LIKE 'http://%' OR url LIKE 'https://%')
""")
def url_list_source(ev):
    return TL.url_batches(ev.url_line.select("batch_id", "pos", "line"))


PATTERNS = """
patterns AS (SELECT line_no, kind, pattern, ignore_case FROM (
  SELECT line_no, CASE WHEN l[1] = '*' THEN 'glob' WHEN l[1] = '/' THEN 'regex' END AS kind,
         CASE WHEN l[1] = '*' THEN l WHEN ends_with(l, '/i') THEN substr(l, 2, length(l) - 3)
              WHEN ends_with(l, '/') THEN substr(l, 2, length(l) - 2) ELSE substr(l, 2) END AS pattern,
         l[1] = '/' AND ends_with(l, '/i') AS ignore_case
  FROM (SELECT line_no, trim(line) AS l FROM fx_blocklist_line WHERE trim(line) <> ''))
  WHERE kind IS NOT NULL AND pattern <> '' AND pattern <> '[invalid(regex')
"""


@query("blocklist_source", "fx_blocklist_line", "WITH " + PATTERNS + "SELECT * FROM patterns")
def blocklist_source(ev):
    return BK.valid_only(BK.parse(ev.blocklist_line))


def listed_of(ev):
    """Back-link matches found on the block list."""
    return BK.blocklist_join(ev.web_match, BK.valid_only(BK.parse(ev.blocklist_line.select("line"))))


LISTED = PATTERNS + """,
forms AS (SELECT pattern AS g FROM patterns WHERE kind = 'glob' UNION
          SELECT substr(pattern, 1, strpos(pattern, '*://*.') - 1) || '*://' || substr(pattern, strpos(pattern, '*://*.') + 6)
          FROM patterns WHERE kind = 'glob' AND contains(pattern, '*://*.')),
listed AS MATERIALIZED (
  SELECT * FROM fx_web_match m WHERE EXISTS (SELECT 1 FROM forms WHERE m.url GLOB g)
    OR EXISTS (SELECT 1 FROM patterns p WHERE kind = 'regex' AND CASE WHEN ignore_case THEN regexp_matches(m.url, p.pattern, 'i') ELSE regexp_matches(m.url, p.pattern) END))
"""


@query("matcher_protocol", "fx_blocklist_line fx_web_match", "WITH " + PATTERNS + """,
    forms AS (SELECT DISTINCT pattern AS g FROM patterns WHERE kind = 'glob' UNION
              SELECT substr(pattern, 1, strpos(pattern, '*://*.') - 1) || '*://' || substr(pattern, strpos(pattern, '*://*.') + 6)
              FROM patterns WHERE kind = 'glob' AND contains(pattern, '*://*.'))
    SELECT kind, count(*) AS matchers FROM (SELECT 'glob' AS kind, g AS p FROM forms UNION ALL
      SELECT DISTINCT 'regex', CASE WHEN ignore_case THEN '(?i)' ELSE '' END || pattern FROM patterns WHERE kind = 'regex') GROUP BY kind
""")
def matcher_protocol(ev):
    matchers = BK.compiled(BK.valid_only(BK.parse(ev.blocklist_line.select("line"))))
    return matchers.groupBy("kind").agg(F.count("*").alias("matchers"))


@query("blocklist_join", "fx_web_match fx_blocklist_line", "WITH " + LISTED + "SELECT image_id, ord, url FROM listed")
def blocklist_join(ev):
    return listed_of(ev).select("image_id", "ord", "url")


# Lookup --------------------------------------------------------------------------------------------------------------

@query("url_candidates", "fx_lookup_input", f"""
    SELECT DISTINCT url AS input_url, url AS candidate_url FROM fx_lookup_input
    UNION SELECT DISTINCT url, {_full_res('url')} FROM fx_lookup_input WHERE {_full_res('url')} IS NOT NULL
""")
def url_candidates(ev):
    return LK.url_candidates(ev.lookup_input)


@query("url_lookup", "fx_lookup_input fx_source fx_registry fx_vote_event fx_report_event fx_fact", "WITH " + VERDICT + f""",
    cand AS (SELECT DISTINCT url AS input_url, url AS candidate_url FROM fx_lookup_input
             UNION SELECT DISTINCT url, {_full_res('url')} FROM fx_lookup_input WHERE {_full_res('url')} IS NOT NULL),
    hits AS (SELECT input_url, image_id, string_agg(DISTINCT candidate_url, '|' ORDER BY candidate_url) AS matched_source_urls
             FROM cand JOIN fx_source s ON s.url = candidate_url
             WHERE image_id IN (SELECT image_id FROM fx_registry) GROUP BY input_url, image_id),
    ranked AS (SELECT h.*, row_number() OVER (PARTITION BY input_url ORDER BY created_at DESC, h.image_id DESC) AS match_rank,
                      count(*) OVER (PARTITION BY input_url) AS match_count, phash, whash,
                      strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at
               FROM hits h JOIN fx_registry r ON h.image_id = r.image_id)
    SELECT i.input_url, coalesce(match_count, 0) AS match_count, k.image_id, matched_source_urls, k.match_rank, phash, whash, created_at,
           vote_real, vote_edited, vote_ai, total_votes, verdict, c2pa, synthid
    FROM (SELECT DISTINCT url AS input_url FROM fx_lookup_input) i LEFT JOIN ranked k ON i.input_url = k.input_url
    LEFT JOIN verdicts v ON v.image_id = k.image_id
""")
def url_lookup(ev):
    images = ev.registry.join(verdicts_of(ev), "image_id")
    out = LK.url_lookup(ev.lookup_input, ev.source, images)
    return out.withColumns({
        "matched_source_urls": F.array_join("matched_source_urls", "|"),
        "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"),
    })


@query("lookup_order", "fx_source fx_registry", """
    SELECT url AS input_url, image_id, row_number() OVER (PARTITION BY url ORDER BY created_at DESC, image_id DESC) AS match_rank
    FROM (SELECT DISTINCT coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]*'), ''), url) AS url, s.image_id, created_at
          FROM fx_source s JOIN fx_registry r ON s.image_id = r.image_id)
""")
def lookup_order(ev):
    # Scheme and host are the key: many images for each, so the order within a key matters.
    key = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://[^/]*", 0), F.lit("")), F.col("url"))
    rows = ev.source.select("image_id", key.alias("input_url")).distinct().join(ev.registry.select("image_id", "created_at"), "image_id")
    return LK.newest_first(rows).select("input_url", "image_id", "match_rank")


# Back-links ----------------------------------------------------------------------------------------------------------

_DOMAIN = """regexp_replace(CASE WHEN lower(trim(domain)) <> '' THEN lower(trim(domain))
   ELSE lower(trim(regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))) END, '^www[.]', '')"""


def _ends(hosts) -> str:
    return "(" + " OR ".join(f"d = '{h}' OR ends_with(d, '.{h}')" for h in hosts) + ")"


_CATEGORY = f"""CASE WHEN {_ends(U.AI_HOSTS)} THEN 'ai-hosting' WHEN {_ends(U.SOCIAL_HOSTS)} THEN 'social'
   WHEN {_ends(U.STOCK_HOSTS)} THEN 'stock-media' WHEN contains(d, 'news') THEN 'news' ELSE 'other' END"""


@query("domain_extract", "fx_web_match", f"SELECT ord, {_DOMAIN} AS domain FROM fx_web_match")
def domain_extract(ev):
    return ev.web_match.select("ord", U.domain(F.col("domain"), F.col("url")).alias("domain"))


@query("domain_classify", "fx_web_match", f"SELECT ord, d AS domain, {_CATEGORY} AS category FROM (SELECT ord, {_DOMAIN} AS d FROM fx_web_match)")
def domain_classify(ev):
    rows = ev.web_match.select("ord", U.domain(F.col("domain"), F.col("url")).alias("domain"))
    return rows.withColumn("category", U.domain_category(F.col("domain")))


@query("timeline_bin", "fx_web_match", """
    SELECT ord, y AS crawl_year, CASE WHEN y < 2020 THEN 'pre-2020' WHEN y <= 2022 THEN '2020-2022' WHEN y IS NOT NULL THEN '2023+' END AS label
    FROM (SELECT ord, TRY_CAST(substr(CASE WHEN ord % 17 = 4 THEN 'n/a' ELSE crawl_date END, 1, 4) AS BIGINT) AS y FROM fx_web_match)
""")
def timeline_bin(ev):
    y = X.crawl_year(F.when(F.col("ord") % 17 == 4, "n/a").otherwise(F.col("crawl_date")))
    return ev.web_match.select("ord", y.alias("crawl_year"), X.timeline_bin(y).alias("label"))


@query("crawl_year", "fx_response", """
    SELECT image_id, raw, CASE WHEN regexp_matches(raw, '^[0-9]{4}') THEN CAST(substr(raw, 1, 4) AS BIGINT) END AS crawl_year
    FROM (SELECT image_id, CASE WHEN image_id % 4 = 3 THEN '' ELSE coalesce(json_extract_string(response_json, '$.results.matches[0].backlinks[0].crawl_date'), '') END AS raw
          FROM fx_response)
""")
def crawl_year(ev):
    raw = F.get_json_object("response_json", "$.results.matches[0].backlinks[0].crawl_date")
    raw = F.when(F.col("image_id") % 4 == 3, "").otherwise(F.coalesce(raw, F.lit("")))
    return ev.response.select("image_id", raw.alias("raw")).withColumn("crawl_year", X.crawl_year(F.col("raw")))


@query("crawl_date_parse", "fx_response", """
    SELECT image_id, ord, CASE WHEN ord = 1 THEN '' WHEN image_id % 3 = 0 THEN 'http://back.example/' || image_id ELSE json_extract_string(response_json, '$.results.matches[0].backlinks[0].url') END AS url,
           CASE WHEN ord = 1 THEN '' ELSE json_extract_string(response_json, '$.results.matches[0].domain') END AS domain,
           CASE WHEN ord = 1 OR raw = '' THEN '' WHEN TRY_CAST(raw AS DATE) IS NOT NULL THEN raw || 'T00:00:00' ELSE raw END AS crawl_date,
           CASE WHEN ord = 1 THEN 0.81::DOUBLE ELSE CAST(json_extract(response_json, '$.results.matches[0].score') AS DOUBLE) / 100 END AS similarity
    FROM (SELECT *, json_extract_string(response_json, '$.results.matches[0].backlinks[0].crawl_date') AS raw FROM fx_response),
         (VALUES (CAST(0 AS BIGINT)), (1)) t(ord)
    WHERE image_id % 12 NOT IN (5, 7)
""")
def crawl_date_parse(ev):
    return BL.response_matches(BL.parse_responses(ev.response))


@query("api_error_class", "fx_response", """
    SELECT image_id, e AS error, CASE WHEN contains(e, '429') OR contains(lower(e), 'rate') OR contains(lower(e), 'too many') THEN 'TinEye rate limit reached. Please wait a few minutes before trying again.'
       WHEN contains(lower(e), 'key') OR contains(lower(e), 'auth') THEN 'TinEye API configuration error. Please contact the site administrator.'
       ELSE 'Unable to complete TinEye search. Please try again later.' END AS summary
    FROM (SELECT image_id, CASE WHEN image_id % 24 = 5 THEN 'Too many requests; slow down' WHEN image_id % 24 = 17 THEN 'Bad API Key' ELSE 'Unknown error' END AS e
          FROM fx_response WHERE image_id % 12 IN (5, 7))
""")
def api_error_class(ev):
    fixed = ev.response.withColumn("response_json", F.when(
        F.col("image_id") % 24 == 17, '{"code":403,"messages":["Bad API Key"]}').otherwise(F.col("response_json")))
    failed = BL.parse_responses(fixed).filter(~F.col("success"))
    return failed.select("image_id", "error", X.api_error_summary(F.col("error")).alias("summary"))


@query("similarity_filter", "fx_web_match", "SELECT image_id, ord, similarity FROM fx_web_match WHERE similarity >= 0.7")
def similarity_filter(ev):
    return BL.similarity_filter(ev.web_match).select("image_id", "ord", "similarity")


GOOD = f"good AS MATERIALIZED (SELECT *, {_DOMAIN} AS d FROM fx_web_match WHERE similarity >= 0.7)"


@query("backlink_domains", "fx_web_match", "WITH " + GOOD + """
    SELECT image_id, d AS domain, n AS matches, rank FROM (
      SELECT image_id, d, n, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, d) AS rank
      FROM (SELECT image_id, d, count(*) AS n FROM good WHERE d <> '' GROUP BY image_id, d)) WHERE rank <= 5
""")
def backlink_domains(ev):
    return BL.domain_counts(BL.similarity_filter(ev.web_match)).withColumn("rank", F.col("rank").cast("bigint"))


@query("backlink_categories", "fx_web_match", "WITH " + GOOD + f"""
    SELECT image_id, category, n AS matches, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, category) AS rank
    FROM (SELECT image_id, {_CATEGORY} AS category, count(*) AS n FROM good WHERE d <> '' GROUP BY ALL)
""")
def backlink_categories(ev):
    return BL.category_counts(BL.similarity_filter(ev.web_match)).withColumn("rank", F.col("rank").cast("bigint"))


@query("backlink_timeline", "fx_web_match", "WITH " + GOOD + """
    SELECT i.image_id, b.ord, b.label, count(g.ord) AS matches
    FROM (SELECT DISTINCT image_id FROM fx_web_match) i
    CROSS JOIN (VALUES (CAST(0 AS BIGINT), 'pre-2020', 0, 2019), (1, '2020-2022', 2020, 2022), (2, '2023+', 2023, 9999)) b(ord, label, lo, hi)
    LEFT JOIN good g ON g.image_id = i.image_id AND g.crawl_date <> '' AND CAST(substr(g.crawl_date, 1, 4) AS INT) BETWEEN b.lo AND b.hi
    GROUP BY i.image_id, b.ord, b.label
""")
def backlink_timeline(ev):
    images = ev.web_match.select("image_id").distinct()
    return BL.timeline_counts(images, BL.similarity_filter(ev.web_match))


OLD_NEW = """
dated AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY crawl_date, ord) AS up,
                 row_number() OVER (PARTITION BY image_id ORDER BY crawl_date DESC, ord DESC) AS down,
                 count(*) OVER (PARTITION BY image_id) AS n FROM good WHERE crawl_date <> ''),
newest AS (SELECT * FROM dated d WHERE down <= 5 AND (n <= 5 OR NOT EXISTS (
             SELECT 1 FROM dated o WHERE o.up <= 5 AND o.image_id = d.image_id AND o.url = d.url AND o.domain = d.domain AND o.crawl_date = d.crawl_date)))
"""


@query("backlink_oldest_newest", "fx_web_match", "WITH " + GOOD + "," + OLD_NEW + """
    SELECT image_id, 'oldest' AS bucket, up AS rank, ord, url, domain, crawl_date FROM dated WHERE up <= 5
    UNION ALL
    SELECT image_id, 'newest', row_number() OVER (PARTITION BY image_id ORDER BY crawl_date DESC, ord DESC), ord, url, domain, crawl_date FROM newest
""")
def backlink_oldest_newest(ev):
    return BL.oldest_newest(BL.similarity_filter(ev.web_match)).withColumn("rank", F.col("rank").cast("bigint"))


@query("newest_minus_oldest", "fx_web_match", "WITH " + GOOD + "," + OLD_NEW + """
    SELECT image_id, ord, url FROM newest WHERE n > 5
""")
def newest_minus_oldest(ev):
    good = BL.similarity_filter(ev.web_match)
    many = good.filter("crawl_date <> ''").groupBy("image_id").count().filter("count > 5").select("image_id")
    out = BL.oldest_newest(good).filter("bucket = 'newest'")
    return out.join(many, "image_id", "left_semi").select("image_id", "ord", "url")


@query("backlink_summary", "fx_web_match fx_blocklist_line", "WITH " + LISTED + """,
    agg AS (SELECT image_id, count(*) + 2 AS total_matches, count(CASE WHEN similarity >= 0.7 THEN 1 END) AS filtered_match_count,
                   min(CASE WHEN similarity >= 0.7 THEN nullif(crawl_date, '') END) AS earliest_date FROM fx_web_match GROUP BY image_id),
    f AS (SELECT *, EXISTS (SELECT 1 FROM listed l WHERE l.image_id = a.image_id AND l.similarity >= 0.7) AS on_blocklist,
                 CASE WHEN filtered_match_count > 0 THEN filtered_match_count ELSE total_matches END AS shown FROM agg a)
    SELECT image_id, total_matches, filtered_match_count, earliest_date, on_blocklist,
           CASE WHEN filtered_match_count > 0 THEN 'FOUND' ELSE 'NOT FOUND' END AS status,
           CASE WHEN shown = 0 THEN 'No matches found.' ELSE shown || ' matches found.' ||
             coalesce(' Earliest: ' || strftime(TRY_CAST(earliest_date AS TIMESTAMP), '%b %Y') || '.', '') ||
             CASE WHEN on_blocklist THEN ' ⚠️ Found on AI image sites.' ELSE ' Not on known AI sites.' END END AS summary
    FROM f
""")
def backlink_summary(ev):
    images = ev.web_match.groupBy("image_id").agg((F.count("*") + 2).alias("total_matches"))
    return BL.summary(images, ev.web_match, listed_of(ev))


@query("iso_utc", "", """
    SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN strftime(to_timestamp(1700000000 + event_id * 7) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM events
""")
def iso_utc(ev):
    raw = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(
        F.concat((F.lit(1700000000) + F.col("event_id") * 7).cast("string"), F.lit(".75"))
    )
    return ev.table("events").select("event_id", X.iso_utc(raw).alias("iso"))
