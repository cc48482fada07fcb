"""Registry and side-table appends: get-or-create by hash, sources, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.operators.skew import dense_ids


def first_submissions(submissions: DataFrame, order: list[str]) -> DataFrame:
    """One row per phash: the first submission keeps its whash and time. Map-side combined, so copies stay cheap."""
    rest = [c for c in submissions.columns if c != "phash"]
    return (
        submissions.groupBy("phash").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
        .select("phash", *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def registry_upsert(existing: DataFrame, submissions: DataFrame, order: list[str]) -> DataFrame:
    """Registry after get-or-create of ``submissions(phash, whash, created_at, ...order)``.

    Known hashes keep their row. New hashes take ids after the largest existing one, in a fixed order that needs no
    single-task sort.
    """
    fresh = first_submissions(submissions, order).join(existing.select("phash"), "phash", "left_anti")
    top = existing.agg(F.coalesce(F.max("image_id"), F.lit(0)).alias("_top"))
    numbered = dense_ids(fresh, "phash", 0, "_n").crossJoin(F.broadcast(top))
    added = numbered.select((F.col("_n") + F.col("_top")).alias("image_id"), "phash", "whash", "created_at")
    return existing.select("image_id", "phash", "whash", "created_at").unionByName(added)


def source_upsert(existing: DataFrame, registry: DataFrame, submitted: DataFrame) -> DataFrame:
    """New distinct ``(image_id, url)`` rows for known hashes and non-blank URLs."""
    rows = submitted.filter((F.coalesce("phash", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    known = rows.join(registry.select("image_id", "phash"), "phash").select("image_id", "url").distinct()
    return known.join(existing.select("image_id", "url"), ["image_id", "url"], "left_anti")


def fact_upsert(existing: DataFrame, results: DataFrame) -> DataFrame:
    """New distinct facts from signed-manifest results ``(image_id, status, summary)`` that were FOUND."""
    found = results.filter("status = 'FOUND'").select(
        "image_id", F.lit("c2pa").alias("analyzer"), F.col("summary").alias("data")
    ).distinct()
    keys = ["image_id", "analyzer", "data"]
    return found.join(existing.select(*keys).distinct(), keys, "left_anti")
