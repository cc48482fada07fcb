"""URL columns: full-resolution variants, display forms, search links, domains and data URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, hosts and link formats.
REDDIT_PREVIEW = r"https?://(?:preview|external-preview)\.redd\.it/([a-zA-Z0-9_\-]+\.(?:jpe?g|png|gif|webp))"
REDDIT_ORIGINAL = "https://i.redd.it/"
REDDIT_NAME_LENGTH = 13
TWITTER_MEDIA = "pbs.twimg.com/media/"
TWITTER_BASE = r"(https?://pbs\.twimg\.com/media/[^?]+)"
TWITTER_FORMAT = r"format=([a-z]+)"
DISPLAY_PATH_CHARS = 20
LENS_PREFIX = "https://lens.google.com/upload?url="
LENS_FALLBACK = "https://images.google.com/"
BING_PREFIX = "https://www.bing.com/images/search?view=detailv2&iss=sbi&form=SBIHMP&q=imgurl:"
BING_FALLBACK = "https://www.bing.com/visualsearch"
TINEYE_PREFIX = "https://tineye.com/search?url="
AI_HOSTS = (
    "civitai.com", "lexica.art", "openart.ai", "mage.space", "tensor.art", "playgroundai.com", "prompthero.com",
    "midjourney.com", "huggingface.co", "replicate.com",
)
SOCIAL_HOSTS = (
    "x.com", "twitter.com", "facebook.com", "instagram.com", "tiktok.com", "reddit.com", "pinterest.com", "tumblr.com",
)
STOCK_HOSTS = (
    "shutterstock.com", "gettyimages.com", "istockphoto.com", "dreamstime.com", "alamy.com", "depositphotos.com",
    "123rf.com", "adobe.com",
)

_NETLOC = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"


def full_res(url: Column) -> Column:
    """A higher-resolution variant of the URL where a rule knows a different one, else null."""
    name = F.regexp_extract(url, REDDIT_PREVIEW, 1)
    base = F.regexp_extract(name, r"^(.*)\.([^.]*)$", 1)
    ext = F.regexp_extract(name, r"^(.*)\.([^.]*)$", 2)
    reddit = F.when(
        name != "",
        F.concat(F.lit(REDDIT_ORIGINAL), F.right(base, F.lit(REDDIT_NAME_LENGTH)), F.lit("."), ext),
    )
    media = F.regexp_extract(url, TWITTER_BASE, 1)
    fmt = F.coalesce(F.nullif(F.regexp_extract(url, TWITTER_FORMAT, 1), F.lit("")), F.lit("jpg"))
    twitter = F.when(
        url.contains(TWITTER_MEDIA) & (media != ""), F.concat(media, F.lit("?format="), fmt, F.lit("&name=orig"))
    )
    return F.coalesce(F.nullif(reddit, url), F.nullif(twitter, url))


def netloc(url: Column) -> Column:
    """Host part with port and user info, empty when the URL has none."""
    return F.regexp_extract(url, _NETLOC, 1)


def display(url: Column) -> Column:
    """Host plus the first characters of the path, for labels."""
    host = netloc(url)
    path = F.regexp_replace(F.regexp_extract(url, _PATH, 1), "^/+", "")
    short = F.concat(
        host, F.lit("/"), F.substring(path, 1, DISPLAY_PATH_CHARS),
        F.when(F.length(path) > DISPLAY_PATH_CHARS, F.lit("...")).otherwise(F.lit("")),
    )
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit(None).cast("string")).when(host == "", url).when(
        path == "", host
    ).otherwise(short)


def quote_plus(text: Column) -> Column:
    """Percent-encoding for query strings: ``~`` stays, ``*`` is encoded, blanks become ``+``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_links(url: Column) -> Column:
    """Reverse-search links as an array of (label, url); TinEye only for public URLs."""
    public = F.coalesce(url, F.lit("")) != ""
    enc = quote_plus(url)

    def link(label: str, value: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), value.alias("url"))

    def prefixed(prefix: str) -> Column:
        return F.concat(F.lit(prefix), enc)

    return F.when(
        public,
        F.array(
            link("Google", prefixed(LENS_PREFIX)), link("Bing", prefixed(BING_PREFIX)),
            link("TinEye", prefixed(TINEYE_PREFIX)),
        ),
    ).otherwise(F.array(link("Google", F.lit(LENS_FALLBACK)), link("Bing", F.lit(BING_FALLBACK))))


def domain(domain_col: Column, url: Column) -> Column:
    """Lower-case domain without a leading ``www.``, taken from the URL when the domain is blank."""
    given = F.nullif(F.lower(F.trim(F.coalesce(domain_col, F.lit("")))), F.lit(""))
    host = F.lower(F.trim(netloc(F.trim(F.coalesce(url, F.lit(""))))))
    return F.regexp_replace(F.coalesce(given, host), r"^www\.", "")


def _host_pattern(hosts: tuple[str, ...]) -> str:
    return r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in hosts) + ")$"


def domain_category(dom: Column) -> Column:
    """``ai-hosting``, ``social``, ``stock-media``, ``news`` or ``other``."""
    low = F.lower(F.coalesce(dom, F.lit("")))
    return (
        F.when(low.rlike(_host_pattern(AI_HOSTS)), "ai-hosting")
        .when(low.rlike(_host_pattern(SOCIAL_HOSTS)), "social")
        .when(low.rlike(_host_pattern(STOCK_HOSTS)), "stock-media")
        .when(low.contains("news"), "news")
        .otherwise("other")
    )


def data_url_encode(mime: Column, content: Column) -> Column:
    """``data:<mime>;base64,<content>`` on one line."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def data_url_parts(url: Column, max_bytes: int | None = None) -> dict[str, Column]:
    """Media type, bytes and error of a ``data:`` URL; the first failing check is the error.

    ``max_bytes`` marks larger content with an error; the bytes stay beside it.
    """
    path = F.regexp_extract(url, r"(?s)^[dD][aA][tT][aA]:([^?#]*)", 1)
    cut = F.instr(path, ",")
    header = F.substr(path, F.lit(1), cut - 1)
    payload = F.substr(path, cut + 1)
    segments = F.filter(F.split(header, ";"), lambda s: s != "")
    media = F.coalesce(F.get(segments, F.lit(0)), F.lit("application/octet-stream"))
    # size() is 0 for an empty header, so the slice below never sees a negative length.
    rest = F.slice(segments, F.lit(2), F.greatest(F.size(segments), F.lit(1)))
    is_base64 = F.exists(rest, lambda s: F.lower(s) == "base64")
    strict = payload.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(payload) % 4 == 0)
    decoded = F.when(strict, F.unbase64(payload))
    # Form decoding would turn "+" into a blank, so it is escaped before percent-decoding.
    escaped = F.regexp_replace(F.replace(payload, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    plain = F.to_binary(F.url_decode(escaped), F.lit("utf-8"))
    content = F.when(is_base64, decoded).otherwise(plain)
    error = (
        F.when(cut == 0, "Invalid data URL.")
        .when(is_base64 & ~strict, "Invalid base64 data URL.")
    )
    malformed = error
    if max_bytes is not None:
        error = error.when(F.octet_length(content) > max_bytes, "Provided data URL is too large.")
    return {
        "media_type": F.when(malformed.isNull(), media),
        "content": F.when(malformed.isNull(), content),
        "error": error,
    }
