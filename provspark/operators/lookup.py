"""Batch URL lookup: which registered images a list of URLs leads to, and what is known about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions import urls as U
from provspark.operators.skew import sliced_row_number

DAY_SECONDS = 86_400


def url_candidates(inputs: DataFrame) -> DataFrame:
    """Distinct ``(input_url, candidate_url)``: the URL itself and its full-resolution variant."""
    distinct = inputs.select(F.col("url").alias("input_url")).filter("input_url is not null").distinct()
    both = F.array(F.col("input_url"), U.full_res(F.col("input_url")))
    # Inputs are distinct and a variant never equals its input, so the exploded pairs are distinct too.
    return distinct.select("input_url", F.explode(F.array_compact(both)).alias("candidate_url"))


def newest_first(matches: DataFrame) -> DataFrame:
    """Add ``match_rank`` per input URL: newest image first, then the higher id; unknown times come last.

    Ranked in slices of a day, so a URL that leads to very many images is not sorted in one task.
    """
    created = F.coalesce(F.unix_micros("created_at"), F.lit(-(1 << 62)))
    return sliced_row_number(
        matches, ["input_url"], [-F.floor(created / (DAY_SECONDS * 1_000_000))],
        [created.desc(), F.col("image_id").desc()], "match_rank",
    )


def url_lookup(inputs: DataFrame, sources: DataFrame, images: DataFrame) -> DataFrame:
    """Matches per distinct input URL, newest first; inputs without any stay with ``match_count`` 0.

    ``images(image_id, created_at, ...)`` carries the payload. Any number of inputs is served.
    """
    candidates = url_candidates(inputs)
    hits = (
        candidates.join(sources.select("image_id", F.col("url").alias("candidate_url")).distinct(), "candidate_url")
        .groupBy("input_url", "image_id").agg(F.sort_array(F.collect_set("candidate_url")).alias("matched_source_urls"))
    )
    ranked = newest_first(hits.join(images, "image_id"))
    counts = ranked.groupBy("input_url").agg(F.count("*").alias("match_count"))
    base = candidates.select("input_url").distinct().join(counts, "input_url", "left").na.fill(0, ["match_count"])
    return base.join(ranked, "input_url", "left")


def triage(error_of: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Add ``error`` to crawl-log rows: the text of the first failing check, null for a usable image.

    Columns: ``url, status, content_type, declared_length, actual_length``; a null status is a failed request. With
    ``max_bytes``, larger images are an error too.
    """
    text = F.coalesce(F.col("content_type"), F.lit(""))
    declared = F.when(F.trim("declared_length").rlike("^[+-]?[0-9]+$"), F.trim("declared_length").try_cast("bigint"))
    too_large = "Downloaded image is too large."
    error: Column = (
        F.when(~F.col("url").rlike("^(?i:https?):"), "Only HTTP/HTTPS URLs are supported.")
        .when(F.col("status").isNull(), "Failed to download image from URL.")
        .when(F.col("status") != 200, "Image URL returned a non-200 status code.")
        .when(~text.contains("image"), "URL does not point to an image.")
    )
    if max_bytes is not None:
        error = error.when(declared > max_bytes, too_large).when(F.col("actual_length") > max_bytes, too_large)
    return error_of.withColumn("error", error)


def prefer_full_res(inputs: DataFrame, log: DataFrame) -> DataFrame:
    """Best successful fetch per input URL: its full-resolution variant if that worked, else the URL itself.

    ``log`` is a triaged crawl log with one row per URL.
    """
    urls = inputs.select("url").distinct().withColumn("full_res_url", U.full_res(F.col("url")))
    full = log.select(F.col("url").alias("full_res_url"), F.col("error").alias("_fe"), F.lit(True).alias("_fl"))
    plain = log.select("url", F.col("error").alias("_pe"), F.lit(True).alias("_pl"))
    # URLs without a variant get a join key of their own each: nulls would all meet in one task.
    key = F.coalesce("full_res_url", F.concat(F.lit("-"), F.col("url")))
    full = full.withColumnRenamed("full_res_url", "_key")
    joined = urls.withColumn("_key", key).join(full, "_key", "left").join(plain, "url", "left")
    upgraded = F.coalesce(F.col("_fl"), F.lit(False)) & F.col("_fe").isNull()
    fetched = F.coalesce(F.col("_pl"), F.lit(False)) & F.col("_pe").isNull()
    return joined.select(
        "url", "full_res_url", upgraded.alias("upgraded"),
        F.when(upgraded, F.col("full_res_url")).when(fetched, F.col("url")).alias("fetch_url"),
        F.when(~upgraded & ~fetched, F.coalesce("_pe", F.lit("Failed to download image from URL."))).alias("error"),
    )
