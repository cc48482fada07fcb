"""Vote and report ledgers: replay of an append-only event log and its current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions import texts as T
from provspark.operators.skew import DEFAULT_SLICE_SECONDS, sliced_lag, time_slice

# Allowed votes with their labels, allowed report results.
VOTE_KINDS = (("real", "Real"), ("edited", "AI-Edited"), ("ai", "AI-Gen"))
VOTE_CHOICES = ("real", "edited", "ai")
REPORT_RESULTS = ("detected", "not_detected")


def _replay(events: DataFrame, known_images: DataFrame, valid: Column, keys: list[str], value: str,
            slice_seconds: int) -> DataFrame:
    known = known_images.select("image_id").distinct().withColumn("_known", F.lit(True))
    flagged = events.join(known, "image_id", "left").withColumn(
        "_ok", F.coalesce(valid, F.lit(False)) & F.col("_known").isNotNull()
    )
    # Rejected events stay in the one pass: their value is null there, so no later event sees them.
    slots = [f"_k{i}" for i in range(len(keys))]
    rows = flagged.withColumns({
        "_slice": time_slice(F.col("ts"), slice_seconds), "_value": F.when(F.col("_ok"), F.col(value)),
        **{s: F.coalesce(F.col(k).cast("string"), F.lit("")) for s, k in zip(slots, keys)},
    })
    lagged = sliced_lag(rows, slots, "_slice", ["ts", "event_id"], "_value", "_previous")
    previous = F.when(F.col("_ok"), F.col("_previous"))
    status = (
        F.when(~F.col("_ok"), "rejected").when(F.col("_previous").isNull(), "recorded")
        .when(F.col("_previous") == F.col(value), "unchanged").otherwise("updated")
    )
    return lagged.select(*events.columns, previous.alias("previous"), status.alias("status"))


def vote_replay(events: DataFrame, known_images: DataFrame,
                slice_seconds: int = DEFAULT_SLICE_SECONDS) -> DataFrame:
    """Outcome of every vote event: recorded, updated, unchanged or rejected, with the choice it replaced."""
    return _replay(events, known_images, F.col("choice").isin(*VOTE_CHOICES), ["image_id", "voter_id"], "choice",
                   slice_seconds)


def normalize_reports(events: DataFrame) -> DataFrame:
    """Detector and provider in catalog form; null where the pair is not accepted."""
    provider = T.detector_provider(F.col("provider"), F.col("detector"))
    return events.withColumn("_p", provider).withColumn(
        "detector", F.when(F.col("_p").isNotNull(), T.detector_key(F.col("detector")))
    ).withColumn("provider", F.col("_p")).drop("_p")


def _report_ok() -> Column:
    return F.col("result").isin(*REPORT_RESULTS) & F.col("detector").isNotNull()


def report_replay(events: DataFrame, known_images: DataFrame,
                  slice_seconds: int = DEFAULT_SLICE_SECONDS) -> DataFrame:
    """Outcome of every detector report after normalising its detector."""
    return _replay(normalize_reports(events), known_images, _report_ok(),
                   ["image_id", "voter_id", "provider", "detector"], "result", slice_seconds)


def current_votes(events: DataFrame, known_images: DataFrame) -> DataFrame:
    """Latest valid choice per (image, voter) of known images; map-side combined."""
    return (
        events.filter(F.col("choice").isin(*VOTE_CHOICES))
        .groupBy("image_id", "voter_id").agg(F.max_by("choice", F.struct("ts", "event_id")).alias("choice"))
        .join(known_images.select("image_id"), "image_id", "left_semi")
    )


def vote_counts(votes: DataFrame) -> DataFrame:
    """Votes per kind and image."""
    return votes.groupBy("image_id").agg(
        *[F.count_if(F.col("choice") == k).alias(f"vote_{k}") for k in VOTE_CHOICES]
    )


def current_reports(events: DataFrame, known_images: DataFrame) -> DataFrame:
    """Latest valid result per (image, voter, provider, detector) of known images, with the id of its first event."""
    keys = ["image_id", "voter_id", "provider", "detector"]
    return (
        normalize_reports(events).filter(_report_ok())
        .groupBy(*keys).agg(F.max_by("result", F.struct("ts", "event_id")).alias("result"),
                            F.min_by("event_id", F.struct("ts", "event_id")).alias("report_id"))
        .join(known_images.select("image_id"), "image_id", "left_semi")
    )


def report_by_detector(reports: DataFrame) -> DataFrame:
    """Detected and not-detected counts per image and detector; blanks take the defaults, the first provider counts."""
    detector = F.coalesce(F.nullif("detector", F.lit("")), F.lit(T.DEFAULT_DETECTOR))
    provider = F.coalesce(F.nullif("provider", F.lit("")), F.lit(T.DEFAULT_PROVIDER))
    return (
        reports.select("image_id", detector.alias("detector"), provider.alias("provider"), "result", "report_id")
        .groupBy("image_id", "detector")
        .agg(F.min_by("provider", "report_id").alias("provider"),
             F.count_if(F.col("result") == "detected").alias("detected"),
             F.count_if(F.col("result") == "not_detected").alias("not_detected"))
        .withColumn("total", F.col("detected") + F.col("not_detected"))
    )


def report_counts(by_detector: DataFrame) -> DataFrame:
    """Counts per image over all detectors."""
    return by_detector.groupBy("image_id").agg(
        F.sum("detected").alias("detected"), F.sum("not_detected").alias("not_detected")
    )


def vote_breakdown(counts: DataFrame, key: str = "image_id") -> DataFrame:
    """One row per key and kind with label, count and share in percent (0 when there are no votes)."""
    total = sum((F.coalesce(f"vote_{k}", F.lit(0)) for k in VOTE_CHOICES), F.lit(0))
    rows = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(k).alias("kind"), F.lit(label).alias("label"),
                 F.coalesce(f"vote_{k}", F.lit(0)).cast("bigint").alias("votes"))
        for i, (k, label) in enumerate(VOTE_KINDS)
    ])
    return (
        counts.select(key, total.cast("bigint").alias("total"), F.explode(rows).alias("s")).select(key, "s.*", "total")
        .withColumn("percent", F.when(F.col("total") == 0, 0.0).otherwise(F.col("votes") / F.col("total") * 100))
    )


def vote_defaults(rows: DataFrame) -> DataFrame:
    """Missing totals as 0, with the sum recomputed."""
    filled = rows.na.fill(0, [f"vote_{k}" for k in VOTE_CHOICES])
    return filled.withColumn("total_votes", F.col("vote_real") + F.col("vote_edited") + F.col("vote_ai"))


def voter_state(pairs: DataFrame, votes: DataFrame, reports: DataFrame) -> DataFrame:
    """Current vote and current reports of each (image, voter); the report map has one entry per catalog detector."""
    per_detector = reports.groupBy("image_id", "voter_id").agg(*[
        F.max(F.when(F.col("detector") == d[0], F.col("result"))).alias(f"report_{d[0]}") for d in T.DETECTORS
    ])
    return (
        pairs.join(votes.withColumnRenamed("choice", "current_vote"), ["image_id", "voter_id"], "left")
        .join(per_detector, ["image_id", "voter_id"], "left")
        .withColumn("current_report", F.col(f"report_{T.DEFAULT_DETECTOR}"))
    )


def report_backfill(rows: DataFrame) -> DataFrame:
    """Set provider, detector and source kind to the defaults wherever any of the three is missing."""
    gap = F.col("provider").isNull() | F.col("detector").isNull() | F.col("source_kind").isNull()
    values = {"provider": T.DEFAULT_PROVIDER, "detector": T.DEFAULT_DETECTOR, "source_kind": T.REPORT_SOURCE_KIND}
    return rows.withColumns({c: F.when(gap, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def report_downgrade_dedup(rows: DataFrame) -> DataFrame:
    """Keep the lowest id per (image, voter); one map-side combined aggregation instead of an anti-join."""
    rest = [c for c in rows.columns if c not in ("image_id", "voter_id")]
    return (
        rows.groupBy("image_id", "voter_id").agg(F.min_by(F.struct(*rest), "id").alias("r"))
        .select("image_id", "voter_id", "r.*")
    )
