"""Small text and number columns: metadata keys, previews, detectors, money, dates and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detector catalog, metadata limits and error texts.
DETECTORS = (
    # detector, provider, label, short label, check label
    ("google_about_this_image", "google", "Google About this image", "Google", "Check Google"),
    ("openai_verify", "openai", "OpenAI Verify", "OpenAI", "OpenAI Verify"),
)
DEFAULT_DETECTOR = "google_about_this_image"
DEFAULT_PROVIDER = "google"
REPORT_SOURCE_KIND = "manual_user_report"
PREVIEW_LIMIT = 200
EXIF_TAG_ALIASES = {"40962": "PixelXDimension", "40963": "PixelYDimension"}
API_RATE_LIMIT = "TinEye rate limit reached. Please wait a few minutes before trying again."
API_CONFIG = "TinEye API configuration error. Please contact the site administrator."
API_GENERIC = "Unable to complete TinEye search. Please try again later."

# White space as Python strips it, for Java patterns.
_WS = r"[\s\x1c-\x1f\x85\p{Z}]"


_WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space, Unicode included, at both ends."""
    return F.btrim(text, F.lit(_WS_CHARS))


def plural(n: Column, suffix: str = "s") -> Column:
    return F.when(n == 1, F.lit("")).otherwise(F.lit(suffix))


def preview(text: Column, limit: int = PREVIEW_LIMIT) -> Column:
    """White space collapsed, cut to ``limit`` characters with an ellipsis."""
    flat = strip(F.regexp_replace(text, f"{_WS}+", " "))
    return F.when(F.char_length(flat) <= limit, flat).otherwise(
        F.concat(F.regexp_replace(F.substring(flat, 1, limit), f"{_WS}+$", ""), F.lit("…"))
    )


def meta_key(key: Column) -> Column:
    """Metadata key without its group prefix; two numeric tags have names."""
    out = F.when(key.startswith("EXIF "), F.substring(key, 6, 1 << 20)).when(
        key.startswith("Image "), F.substring(key, 7, 1 << 20)
    ).otherwise(key)
    for tag, name in EXIF_TAG_ALIASES.items():
        out = F.when(key == tag, name).otherwise(out)
    return out


def detector_key(detector: Column) -> Column:
    """Known detector name in lower case, or null."""
    low = F.lower(F.trim(F.coalesce(detector, F.lit(""))))
    return F.when(low.isin([d[0] for d in DETECTORS]), low)


def detector_provider(provider: Column, detector: Column) -> Column:
    """The detector's provider, or null when the detector is unknown or another provider is named."""
    key = detector_key(detector)
    given = F.lower(F.trim(F.coalesce(provider, F.lit(""))))
    expected = F.lit(None).cast("string")
    for name, prov, *_ in DETECTORS:
        expected = F.when(key == name, prov).otherwise(expected)
    return F.when((given == "") | (given == expected), expected)


def amount_to_cents(amount: Column) -> Column:
    """Decimal text to cents, half away from zero; blank or invalid is 0."""
    value = F.when(F.trim(amount) != "", F.trim(amount).try_cast("decimal(28,10)"))
    return F.coalesce(F.round(value * 100, 0).cast("bigint"), F.lit(0).cast("bigint"))


def voter_key(address: Column, salt: str) -> Column:
    """Hex SHA-256 of ``address:salt``."""
    return F.sha2(F.concat(address, F.lit(":" + salt)), 256)


def iso_utc(seconds: Column) -> Column:
    """Epoch seconds as ``YYYY-MM-DDTHH:MM:SSZ``, null when not numeric; needs a UTC session."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds.try_cast("double"))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def api_error_summary(error: Column) -> Column:
    """User-facing text for an API error, first fitting class wins."""
    low = F.lower(error)
    return (
        F.when(error.contains("429") | low.contains("rate") | low.contains("too many"), API_RATE_LIMIT)
        .when(low.contains("key") | low.contains("auth"), API_CONFIG)
        .otherwise(API_GENERIC)
    )


def crawl_year(crawl_date: Column) -> Column:
    """Year of a crawl date: its first four digits, else an ISO parse, else null."""
    head = F.regexp_extract(crawl_date, r"^([0-9]{4})", 1)
    parsed = F.year(F.try_to_timestamp(F.replace(crawl_date, F.lit("Z"), F.lit("+00:00"))))
    return F.when(head != "", head.try_cast("bigint")).otherwise(parsed.cast("bigint"))


def timeline_bin(year: Column) -> Column:
    return F.when(year < 2020, "pre-2020").when(year <= 2022, "2020-2022").when(year.isNotNull(), "2023+")


def crawl_date_iso(raw: Column) -> Column:
    """``YYYY-MM-DD`` as an ISO date-time text; text of another form stays as it is, missing becomes empty."""
    day = F.try_to_timestamp(raw, F.lit("yyyy-MM-dd"))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), raw, F.lit(""))
