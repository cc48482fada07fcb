"""Community consensus and watermark reports rolled up over the neighbors of each query image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions import texts as T

# Tier weights, gate and contradiction ratio of the watermark score.
WEIGHT_SAME_ENTRY = 1.0
WEIGHT_SAME_HASH = 0.75
WEIGHT_SIMILAR = 0.5
DETECTED_SCORE = 4
CONTRADICTION_RATIO = 3


VOTE_MEASURES = ["vote_real", "vote_edited", "vote_ai"]
REPORT_MEASURES = ["detected", "not_detected"]


def _all(*columns: str) -> Column:
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0])).cast("bigint")


def _tiers(m: str) -> tuple[str, str, str]:
    return f"self_{m}", f"same_{m}", f"similar_{m}"


def human_consensus(sums: DataFrame) -> DataFrame:
    """Vote totals and status per query image over its neighbors that ever had a vote.

    ``sums`` are the tier sums of the vote counts (``neighbors.neighbor_sums`` with ``VOTE_MEASURES``).
    """
    out = sums.select(
        "query_id", *[_all(*_tiers(m)).alias(m) for m in VOTE_MEASURES], _all(*_tiers("n")).alias("match_count"),
        _all("same_n", "similar_n").alias("distant_match_count"), F.col("local_n").cast("bigint").alias("local_match_count"),
    )
    out = out.withColumn("total_votes", F.col("vote_real") + F.col("vote_edited") + F.col("vote_ai"))
    d, n = F.col("distant_match_count"), F.col("total_votes")
    summary = (
        F.when(d > 0, F.concat(d, F.lit(" similar image"), T.plural(d), F.lit(" with "), n, F.lit(" votes total.")))
        .when(F.col("match_count") > 0, F.concat(n, F.lit(" direct vote"), T.plural(n), F.lit(" recorded.")))
        .otherwise("No community consensus yet.")
    )
    text = F.when(d == 1, "Similar image with votes:").when(d > 1, "Similar images with votes:").otherwise("")
    return out.withColumns({
        "status": F.when(F.col("match_count") > 0, "FOUND").otherwise("NOT FOUND"),
        "summary": summary,
        "matches_summary": text,
    })


def reported(reports: DataFrame) -> DataFrame:
    """Images with at least one report; the others do not count as neighbors of the score."""
    return reports.filter("detected > 0 or not_detected > 0")


def watermark_score(sums: DataFrame) -> DataFrame:
    """Weighted report score, state and texts per query image.

    ``sums`` are the tier sums of the report counts (``neighbors.neighbor_sums`` over ``reported`` with
    ``REPORT_MEASURES``).
    """
    yes, no = F.col("self_detected"), F.col("self_not_detected")
    contradicted = (yes > 0) & (no >= CONTRADICTION_RATIO * yes)
    points = (
        F.when(contradicted, 0.0).otherwise(WEIGHT_SAME_ENTRY * yes) + WEIGHT_SAME_HASH * F.col("same_detected")
        + WEIGHT_SIMILAR * F.col("similar_detected")
    )
    out = sums.select(
        "query_id", points.alias("score"), yes.cast("bigint").alias("self_detected"), no.cast("bigint").alias("self_not_detected"),
        _all(*_tiers("detected")).alias("total_detected"), _all(*_tiers("not_detected")).alias("total_not_detected"),
        _all("same_n", "similar_n").alias("similar_count"), _all(*_tiers("n")).alias("report_images"),
    )
    sd, sn = F.col("self_detected"), F.col("self_not_detected")
    td, all_ = F.col("total_detected"), F.col("total_detected") + F.col("total_not_detected")
    score = F.col("score")
    manual = (score == 0) & (F.col("report_images") == 0)
    similar_only = (sd == 0) & (td > 0)
    summary = (
        F.when(manual, "Check for invisible SynthID watermarking.")
        .when(score == 0, F.concat(F.lit("Checked by "), all_, F.lit(" user"), T.plural(all_),
                                   F.lit(", not detected on this version.")))
        .when((score < DETECTED_SCORE) & similar_only,
              F.concat(td, F.lit(" user"), T.plural(td), F.lit(" reported detecting SynthID on a similar image.")))
        .when(score < DETECTED_SCORE, F.concat(td, F.lit(" user"), T.plural(td), F.lit(" reported detecting SynthID.")))
        .otherwise(F.concat(F.lit("SynthID detected by "), td, F.lit(" user"), T.plural(td), F.lit(".")))
    )
    status = (
        F.when(manual, "MANUAL").when(score == 0, "CHECKED").when(score < DETECTED_SCORE, "REPORTED").otherwise("DETECTED")
    )
    contested = (sd > 0) & (sn > 0) & (sn >= sd) & (sn <= CONTRADICTION_RATIO * sd)
    # The state shown for each status, and the note to reports that are few.
    state = F.lower(status)
    caveat = F.when(status == "REPORTED", "Verify this yourself; SynthID checks are provider-specific and can vary across different copies of an image.")
    return out.withColumns({"contested": contested, "status": status, "summary": summary, "display_state": state, "caveat": caveat}).drop("report_images")


def detector_measures(by_detector: DataFrame) -> tuple[DataFrame, list[str]]:
    """Report counts per image with one pair of columns per catalog detector."""
    names, cols = [], []
    for detector, *_ in T.DETECTORS:
        for kind in REPORT_MEASURES:
            names.append(f"{detector}__{kind}")
            cols.append(F.sum(F.when(F.col("detector") == detector, F.col(kind)).otherwise(0)).alias(names[-1]))
    return by_detector.groupBy("image_id").agg(*cols), names


def detector_totals(sums: DataFrame) -> DataFrame:
    """Counts per query image and catalog detector over all neighbors, zero-filled, with labels.

    ``sums`` are the tier sums of ``detector_measures``.
    """
    rows = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(d).alias("detector"), F.lit(p).alias("provider"), F.lit(l).alias("label"),
                 F.lit(s).alias("short_label"), F.lit(c).alias("check_label"), _all(*_tiers(f"{d}__detected")).alias("detected"),
                 _all(*_tiers(f"{d}__not_detected")).alias("not_detected"))
        for i, (d, p, l, s, c) in enumerate(T.DETECTORS)
    ])
    out = sums.select("query_id", F.explode(rows).alias("r")).select("query_id", "r.*")
    return out.withColumn("total", F.col("detected") + F.col("not_detected"))


def image_verdict(images: DataFrame, votes: DataFrame, facts: DataFrame, reports: DataFrame) -> DataFrame:
    """Majority vote, signed-manifest flag and watermark majority per image."""
    signed = facts.groupBy("image_id").agg(F.bool_or(F.col("analyzer") == "c2pa").alias("c2pa"))
    out = (
        images.join(votes, "image_id", "left").join(signed, "image_id", "left").join(reports, "image_id", "left")
        .na.fill(0, ["vote_real", "vote_edited", "vote_ai"]).na.fill({"c2pa": False})
    )
    r, e, a = F.col("vote_real"), F.col("vote_edited"), F.col("vote_ai")
    verdict = F.when(r + e + a > 0, F.when((r >= e) & (r >= a), "real").when(e >= a, "edited").otherwise("ai"))
    mark = F.when(F.col("detected") > F.col("not_detected"), True).when(F.col("not_detected") > F.col("detected"), False)
    return out.withColumns({"total_votes": r + e + a, "verdict": verdict, "synthid": mark}).drop("detected", "not_detected")


def signed_measures(facts: DataFrame) -> DataFrame:
    """Number of signed-manifest facts per image that has any, as measure ``facts``."""
    return facts.filter("analyzer = 'c2pa'").groupBy("image_id").agg(F.count("*").alias("facts"))


def fact_matches(results: DataFrame, sums: DataFrame) -> DataFrame:
    """Signed-manifest status per query after looking at other neighbors' facts.

    ``results(query_id, status, summary, ...)``: NOT AVAILABLE and ERROR pass through without matches, further columns
    unchanged. ``sums`` are the tier sums of ``signed_measures``.
    """
    found = sums.select("query_id", _all("same_facts", "similar_facts").alias("match_count"))
    out = found.join(results, "query_id")
    closed = F.col("status").isin("NOT AVAILABLE", "ERROR")
    n = F.when(closed, F.lit(0).cast("bigint")).otherwise(F.col("match_count"))
    similar = (F.col("status") == "NOT FOUND") & (n > 0)
    text = F.concat(F.lit("Found "), n, F.lit(" visually similar image"), T.plural(n), F.lit(" with C2PA metadata."))
    extra = [c for c in results.columns if c not in ("query_id", "status", "summary")]
    return out.select(
        "query_id", *extra, F.when(similar, "SIMILAR").otherwise(F.col("status")).alias("status"),
        F.when(similar, text).otherwise(F.col("summary")).alias("summary"), n.alias("match_count"),
        (n > 0).alias("has_distant_matches"),
    )
