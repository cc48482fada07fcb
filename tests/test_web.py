"""URL rules, lookups, back-links and block lists."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from provspark.functions import texts as X
from provspark.functions import urls as U
from provspark.operators import backlinks as BL
from provspark.operators import blocklist as BK
from provspark.operators import lookup as LK
from provspark.sources import text_lists as TL


@pytest.mark.parametrize("url,expect", [
    ("https://preview.redd.it/abc123def456g.jpeg?width=1", "https://i.redd.it/abc123def456g.jpeg"),
    ("https://preview.redd.it/verylongfilename123.png", "https://i.redd.it/ngfilename123.png"),
    ("https://external-preview.redd.it/xyz789abcdefg.webp?auto=webp", "https://i.redd.it/xyz789abcdefg.webp"),
    ("https://i.redd.it/abc123.jpg", None),
    ("https://pbs.twimg.com/media/ABC123?format=jpg&name=small", "https://pbs.twimg.com/media/ABC123?format=jpg&name=orig"),
    ("https://pbs.twimg.com/media/XYZ789?format=png&name=medium", "https://pbs.twimg.com/media/XYZ789?format=png&name=orig"),
    ("https://pbs.twimg.com/media/ABC123?format=jpg&name=orig", None),
    ("https://pbs.twimg.com/media/ABC123?name=small", "https://pbs.twimg.com/media/ABC123?format=jpg&name=orig"),
    ("https://example.com/media/image.jpg", None), ("", None), (None, None),
])
def test_full_res(one, url, expect):
    assert one(U.full_res, "u string", url) == expect


@pytest.mark.parametrize("url,expect", [
    ("https://host.example:8080/a/b.jpg?q=1", "host.example:8080/a/b.jpg"),
    ("https://host.example/0123456789012345678901234", "host.example/01234567890123456789..."),
    ("https://host.example", "host.example"), ("just text", "just text"), (None, None),
])
def test_display(one, url, expect):
    assert one(U.display, "u string", url) == expect


def test_search_links(one):
    links = one(U.search_links, "u string", "https://a.example/x y~*.jpg")
    assert [r.label for r in links] == ["Google", "Bing", "TinEye"]
    assert links[0].url == "https://lens.google.com/upload?url=https%3A%2F%2Fa.example%2Fx+y~%2A.jpg"
    fallback = one(U.search_links, "u string", None)
    assert [r.url for r in fallback] == ["https://images.google.com/", "https://www.bing.com/visualsearch"]


@pytest.mark.parametrize("url,media,content,error", [
    ("data:image/png;base64,aGVsbG8=", "image/png", b"hello", None),
    ("data:;base64,aGVsbG8=", "base64", b"aGVsbG8=", None),
    ("data:,a%20b+c", "application/octet-stream", b"a b+c", None),
    ("data:text/plain,100%", "text/plain", b"100%", None),
    ("data:image/png;base64,@@@", None, None, "Invalid base64 data URL."),
    ("data:nothing", None, None, "Invalid data URL."),
    ("data:image/png;base64,aGVsbG8gd29ybGQgaGVsbG8=", "image/png", b"hello world hello", "Provided data URL is too large."),
])
def test_data_urls(spark, url, media, content, error):
    df = spark.createDataFrame([(url,)], "u string")
    parts = U.data_url_parts(F.col("u"), 12)
    got = df.select(*[parts[k].alias(k) for k in ("media_type", "content", "error")]).first()
    assert (got.media_type, bytes(got.content) if got.content is not None else None, got.error) == (media, content, error)


def test_lookup(table):
    inputs = table("url string", ("https://example.com/known.jpg",), ("https://preview.redd.it/abc1234567890.jpg?w=1",),
                   ("https://example.com/none.jpg",), ("https://example.com/known.jpg",), (None,))
    sources = table("image_id bigint, url string", (1, "https://example.com/known.jpg"), (2, "https://example.com/known.jpg"),
                    (3, "https://i.redd.it/abc1234567890.jpg"))
    images = table("image_id bigint, s bigint", (1, 100), (2, 900), (3, 5)).withColumn("created_at", F.timestamp_seconds("s"))
    rows = LK.url_lookup(inputs, sources, images).orderBy("input_url", "match_rank").collect()
    got = [(r.input_url, r.match_count, r.image_id) for r in rows]
    assert got == [("https://example.com/known.jpg", 2, 2), ("https://example.com/known.jpg", 2, 1),
                   ("https://example.com/none.jpg", 0, None), ("https://preview.redd.it/abc1234567890.jpg?w=1", 1, 3)]


def test_url_batches(table):
    rows = [(1, i, f"http://a.example/{i}") for i in range(11)]
    rows += [(2, 0, " http://a.example/x "), (2, 1, ""), (2, 2, "not-a-url"), (2, 3, "http://a.example/x"), (2, 4, "https://b.example")]
    lines = table("batch_id bigint, pos bigint, line string", *rows)
    assert TL.url_batches(lines).where("batch_id = 1 and error is null").count() == 11
    got = TL.url_batches(lines, cap=10).collect()
    assert [r.error for r in got if r.batch_id == 1] == ["Maximum 10 URLs per batch."]
    two = {(r.pos, r.url, r.error) for r in got if r.batch_id == 2}
    assert two == {(0, "http://a.example/x", None), (2, "not-a-url", "Invalid URL format"), (4, "https://b.example", None)}


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n\nthree")
    rows = TL.read_lines(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.line for r in rows] == ["one", "two", "", "three"]


MATCH = "image_id bigint, ord bigint, url string, domain string, crawl_date string, similarity double"


def test_backlink_intelligence(table):
    m = table(MATCH, (1, 0, "https://x.com/example/status/1", "x.com", "2019-04-01T00:00:00", 0.95),
              (1, 1, "https://example-news.com/story", "example-news.com", "2021-05-01T00:00:00", 0.88),
              (1, 2, "https://civitai.com/images/1", "civitai.com", "2024-01-01T00:00:00", 0.93),
              (1, 3, "https://civitai.com/images/2", "civitai.com", "2024-06-01T00:00:00", 0.91))
    top = [(r.domain, r.matches) for r in BL.domain_counts(m).orderBy("rank").collect()]
    assert top[0] == ("civitai.com", 2) and len(top) == 3
    assert {(r.category, r.matches) for r in BL.category_counts(m).collect()} == {("ai-hosting", 2), ("social", 1), ("news", 1)}
    bins = BL.timeline_counts(table("image_id bigint", (1,), (2,)), m).orderBy("image_id", "ord").collect()
    assert [(r.label, r.matches) for r in bins[:3]] == [("pre-2020", 1), ("2020-2022", 1), ("2023+", 2)]
    assert [r.matches for r in bins[3:]] == [0, 0, 0]


def test_oldest_newest(table):
    few = [(1, i, f"u{i}", "d", f"202{i}-01-01", 0.9) for i in range(4)]
    many = [(2, i, f"u{i}", "d", f"201{i}-01-01", 0.9) for i in range(7)]
    got = BL.oldest_newest(table(MATCH, *few, *many, (2, 9, "x", "d", "", 0.9))).collect()

    def of(image, bucket):
        return [r.ord for r in sorted(got, key=lambda r: r["rank"]) if (r.image_id, r.bucket) == (image, bucket)]

    assert of(1, "oldest") == [0, 1, 2, 3] and of(1, "newest") == [3, 2, 1, 0]
    assert of(2, "oldest") == [0, 1, 2, 3, 4] and of(2, "newest") == [6, 5]


def test_backlink_summary(table):
    m = table(MATCH, (1, 0, "https://civitai.com/1", "", "2021-05-01T00:00:00", 0.9), (2, 0, "https://a.example/", "", "", 0.1))
    images = table("image_id bigint, total_matches bigint", (1, 9), (2, 4), (3, 0))
    got = {r.image_id: (r.status, r.summary) for r in BL.summary(images, m, m.filter("image_id = 1")).collect()}
    assert got[1] == ("FOUND", "1 matches found. Earliest: May 2021. ⚠️ Found on AI image sites.")
    assert got[2] == ("NOT FOUND", "4 matches found. Not on known AI sites.")
    assert got[3] == ("NOT FOUND", "No matches found.")


@pytest.mark.parametrize("domain,category", [
    ("civitai.com", "ai-hosting"), ("cdn.civitai.com", "ai-hosting"), ("notcivitai.com", "other"), ("old.reddit.com", "social"),
    ("stock.adobe.com", "stock-media"), ("daily-news.org", "news"), ("", "other"), (None, "other"),
])
def test_domain_category(one, domain, category):
    assert one(U.domain_category, "d string", domain) == category


@pytest.mark.parametrize("raw,year", [("2021-05-01", 2021), ("", None), ("spring", None), ("1999", 1999)])
def test_crawl_year(one, raw, year):
    assert one(X.crawl_year, "d string", raw) == year


LINES = """# Comment line
   # Indented comment

*://*.civitai.com/*
/artstation\\.com\\/artwork/i
 *://*.huggingface.co/*
/[invalid(regex/
*://example.org/*
*/gallery?id=[0-9]*
*[!a-z].png
/^https:..plain/
ignored
*://*.bücher.example/*
/unclosed\\.net
*"""


def _python_match(url, lines):
    for line in lines.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("*"):
            if fnmatch.fnmatchcase(url, line):
                return True
            if "*://*." in line and fnmatch.fnmatchcase(url, line.replace("*://*.", "*://", 1)):
                return True
        elif line.startswith("/"):
            flags, body = (re.I, line[:-2]) if line.endswith("/i") else (0, line[:-1] if line.endswith("/") else line)
            try:
                if body[1:] and re.search(body[1:], url, flags):
                    return True
            except re.error:
                pass
    return False


def test_blocklist_against_python(spark):
    lines = "\n".join(LINES.splitlines()[:-1])
    rng = random.Random(1)
    hosts = ["civitai.com", "www.civitai.com", "notcivitai.com", "a.b.huggingface.co", "example.org", "www.example.org",
             "ARTSTATION.com", "x.example", "bücher.example", "unclosed.net", "civitai.com.evil"]
    paths = ["/", "", "/artwork", "/gallery?id=7", "/galleryXid=7a", "/pic9.png", "/pica.png", "/x/civitai.com/y", "/r?u=https://civitai.com/z",
             "/a://example.org/b", "/q.civitai.com"]
    urls = [f"{rng.choice(['https', 'http', 'ftp', ''])}://{h}{p}" for h in hosts for p in paths] + ["https:/plain", "https://plain", "civitai.com/", ""]
    patterns = BK.valid_only(BK.parse(spark.createDataFrame([(x,) for x in lines.splitlines()], "line string")))
    assert patterns.count() == 9
    got = {r.url for r in BK.blocklist_join(spark.createDataFrame([(u,) for u in urls], "url string"), patterns).collect()}
    assert got == {u for u in urls if u and _python_match(u, lines)}


PYTHON_ONLY = ["/{id}/", "/[[]x|aa/", "/(?P<n>a)(?P=n)/", "/(?P<n>x)1?/", "/(?P<n>b)b/", "/(?x)zz #c/", "/aa/", "/\\d\\w{2}é/i", "/(?i)KELVIN/", "/spec[io]al.+end$/", "/^..$/", "/(?:one|two)three/", "*[!a]x?", "*://*.h.example/*"]


def test_patterns_that_only_python_accepts_beside_any_number_of_others(spark):
    urls = ["http://h/{id}", "http://q/aa", "http://[x", "http://1/bb", "zz", "http://r/9abÉ", "kelKvin", "KELVIN", "special x end", "specoal end", "ab", "onethree", "two-three", "twothree", "bxy", "axy", "", "http://a.h.example/b", "ſpecial x end"]
    lines = "\n".join(PYTHON_ONLY)
    want = {u for u in urls if u and _python_match(u, lines)}
    assert {"http://h/{id}", "http://q/aa", "http://1/bb", "zz", "onethree"} <= want
    table = spark.createDataFrame([(u,) for u in urls], "url string")

    def matched(more):
        patterns = BK.valid_only(BK.parse(spark.createDataFrame([(x,) for x in PYTHON_ONLY + more], "line string")))
        return {r.url for r in BK.blocklist_join(table, patterns).collect()}

    assert matched([]) == want
    assert matched([f"*/never-{i}?*" for i in range(5_000)] + [f"/absent{i}[0-9]/" for i in range(5_000)]) == want


@pytest.mark.parametrize("kind,pattern,fold,literal", [
    ("glob", "*adserver*", False, "adserver"), ("glob", "*/page-12?*", False, "/page-12"), ("glob", "*://*.foobar.*/barbaz*", False, ".foobar."),
    ("glob", "*a[x]]long*", False, "]long"), ("glob", "*[!]]tail", False, "tail"), ("glob", "*[open", False, "[open"), ("glob", "*", False, ""), ("glob", "*Größe-ABC*", False, "e-abc"),
    ("regex", r"abc\.def(ghi)?x", False, "abc.def"), ("regex", "one|two", False, ""), ("regex", "asking", True, "ng"), ("regex", "[bad", False, ""), ("regex", "(?i)ad", False, "ad"),
])
def test_literal_of(kind, pattern, fold, literal):
    assert BK.literal_of(kind, pattern, fold) == literal


def test_every_glob_of_the_fixture_has_a_literal(spark):
    from provspark.plans.fixtures import Evidence

    globs = BK.compiled(BK.valid_only(BK.parse(Evidence(spark, "/root/testdata/sf0.001").blocklist_line.select("line")))).filter("kind = 'glob'")
    for r in globs.collect():
        runs = [t for t in r.pattern.replace("?", "*").split("*") if len(t) >= 4 and "[" not in t]
        assert len(BK.literal_of("glob", r.pattern, False)) >= max(map(len, runs), default=0)


@pytest.mark.parametrize("chars", [40, 300, BK.AUTOMATON_CHARS])
def test_one_and_many_automata_agree(spark, chars):
    lines = PYTHON_ONLY + [f"*/page-{i}?*" for i in range(12)] + ["*adserver*", "*track[0-9]er*"]
    urls = ["http://a/page-3x", "http://a/page-19", "http://x/ADSERVER", "http://x/adserver1", "track5er", "trackXer", "zz", "ab", "nothing here", "KELVIN"] * 2
    patterns = BK.valid_only(BK.parse(spark.createDataFrame([(x,) for x in lines], "line string")))
    got = sorted(r.url for r in BK.blocklist_join(spark.createDataFrame([(u,) for u in urls], "url string"), patterns, chars).collect())
    assert got == sorted(u for u in urls if _python_match(u, "\n".join(lines)))


def test_glob_lists(spark):
    rows = [(f"*/page-{i}?*",) for i in range(20)]
    patterns = BK.parse(spark.createDataFrame(rows, "line string"))
    urls = spark.createDataFrame([("http://a/page-3x",), ("http://a/page-19",), ("http://a/page-7zz",), ("http://b/",)], "url string")
    # "page-19" is on the list as "page-1?".
    want = {"http://a/page-3x", "http://a/page-19", "http://a/page-7zz"}
    assert {r.url for r in BK.blocklist_join(urls, patterns).collect()} == want


@pytest.mark.parametrize("row,error", [
    (("ftp://x", 200, "image/png", None, 1), "Only HTTP/HTTPS URLs are supported."),
    (("http://x", None, "image/png", None, 1), "Failed to download image from URL."),
    (("http://x", 404, "text/html", None, 1), "Image URL returned a non-200 status code."),
    (("http://x", 200, "text/html", "999", 1), "URL does not point to an image."),
    (("http://x", 200, "image/png", "999", 1), "Downloaded image is too large."),
    (("http://x", 200, "image/png", "abc", 101), "Downloaded image is too large."),
    (("http://x", 200, "image/png", "abc", 100), None),
])
def test_triage(table, row, error):
    df = table("url string, status int, content_type string, declared_length string, actual_length bigint", row)
    assert LK.triage(df, 100).first().error == error


@pytest.mark.parametrize("amount,cents", [("10.005", 1001), ("5", 500), ("", 0), (None, 0), ("ten", 0), ("-1.50", -150)])
def test_cents(one, amount, cents):
    assert one(X.amount_to_cents, "a string", amount) == cents


def test_shared_folder_or_error():
    from types import SimpleNamespace

    from provspark.session import work_folder

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_folder(cluster, "x")
