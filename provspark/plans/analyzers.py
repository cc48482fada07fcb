"""The analyzers as named DataFrame transforms, their stored rows and the report built from them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions import boxes as B
from provspark.functions import hashing as H
from provspark.functions import texts as X
from provspark.functions import urls as U
from provspark.operators import consensus as C
from provspark.operators import manifests as M
from provspark.operators import metadata as MD
from provspark.operators import neighbors as N

LOG = logging.getLogger(__name__)

# Texts, statuses and the report version.
REPORT_VERSION = "1.1"
NOT_RUN_SUMMARY = "Analyzer row is not available yet."
EXPIRED_SUMMARY = "Analysis expired. Please re-run."
BACKLINK_PROMPT = "Search for this image across the web."
SUMMARY_FALLBACK = {"manual": "Manual check required", "loading": "Running…"}
NOTABLE = ("FOUND", "DETECTED", "SIMILAR")
EVIDENCE_EXCLUDED = "tineye"


@dataclass
class Inputs:
    """Tables the analyzers read; all keyed by query image or registry image."""

    queries: DataFrame       # query_id, registry_id, phash, whash
    registry: DataFrame      # image_id, phash, whash
    local: DataFrame         # query_id, neighbor_id of geometric matches
    votes: DataFrame         # image_id, vote_real, vote_edited, vote_ai
    reports: DataFrame       # image_id, detected, not_detected
    facts: DataFrame         # image_id, analyzer, data
    manifests: DataFrame     # image_id (= query id), manifest_json; a query without a row has no manifest
    chunks: DataFrame        # image_id (= query id), key, value

    _sums: DataFrame | None = field(default=None, repr=False)

    def sums(self, names: list[str], count: str) -> DataFrame:
        """Tier sums of some measures with ``count`` as the number of neighbors; all come from one pass over the hashes."""
        if self._sums is None:
            votes = self.votes.withColumn("has_votes", F.lit(1))
            reports = C.reported(self.reports).withColumn("has_reports", F.lit(1))
            signed = C.signed_measures(self.facts).withColumn("has_facts", F.lit(1))
            measures = votes.join(reports, "image_id", "full").join(signed, "image_id", "full").na.fill(0)
            every = [*C.VOTE_MEASURES, *C.REPORT_MEASURES, "facts", "has_votes", "has_reports", "has_facts"]
            self._sums = N.neighbor_sums(self.queries, self.registry, measures, every, self.local)
        tiers = ("self", "same", "similar", "local")
        return self._sums.select(
            "query_id", *[f"{t}_{m}" for t in tiers for m in names], *[F.col(f"{t}_{count}").alias(f"{t}_n") for t in tiers]
        )


@dataclass(frozen=True)
class AnalyzerSpec:
    """A named transform from the inputs to ``(query_id, status, summary, data)`` with ``data`` as JSON text."""

    name: str
    slug: str
    transform: Callable[[Inputs], DataFrame]


def _signed(inp: Inputs) -> DataFrame:
    ids = inp.queries.select("query_id")
    asked = inp.manifests.join(ids.withColumnRenamed("query_id", "image_id"), "image_id", "left_semi")
    tool = M.manifest_active(asked).withColumnRenamed("image_id", "query_id")
    results = ids.join(tool, "query_id", "left").select(
        "query_id", F.coalesce("status", F.lit("NOT FOUND")).alias("status"),
        F.coalesce("summary", F.lit(M.NO_MANIFEST)).alias("summary"), "signer", "tool", "origin_label", "provenance_depth",
        "manifest_label", "manifest_count", "manifest_title", "manifest_format",
    )
    out = C.fact_matches(results, inp.sums(["facts"], "has_facts"))
    data = F.to_json(F.struct("signer", "tool", "origin_label", "provenance_depth", "manifest_label", "manifest_count", "manifest_title",
                              "manifest_format", "match_count", "has_distant_matches"))
    return out.select("query_id", "status", "summary", data.alias("data"))


def _watermark(inp: Inputs) -> DataFrame:
    out = C.watermark_score(inp.sums(C.REPORT_MEASURES, "has_reports"))
    data = F.to_json(F.struct("display_state", "score", "contested", "self_detected", "self_not_detected", "total_detected", "total_not_detected", "similar_count", (F.col("similar_count") > 0).alias("has_distant_matches"), "caveat"))
    return out.select("query_id", "status", "summary", data.alias("data"))


def _backlinks(inp: Inputs) -> DataFrame:
    return inp.queries.select(
        "query_id", F.lit("MANUAL").alias("status"), F.lit(BACKLINK_PROMPT).alias("summary"),
        F.lit('{"allow_manual_refresh":true}').alias("data"),
    )


def _metadata(inp: Inputs) -> DataFrame:
    images = inp.queries.select(F.col("query_id").alias("image_id"))
    out = MD.ai_metadata(images, MD.normalize_keys(inp.chunks))
    return out.select(F.col("image_id").alias("query_id"), "status", "summary",
                      F.to_json(F.struct("finding_count")).alias("data"))


def _human(inp: Inputs) -> DataFrame:
    out = C.human_consensus(inp.sums(C.VOTE_MEASURES, "has_votes"))
    data = F.to_json(F.struct("vote_real", "vote_edited", "vote_ai", "total_votes", "match_count", "distant_match_count", "local_match_count", "matches_summary"))
    return out.select("query_id", "status", "summary", data.alias("data"))


ANALYZERS: tuple[AnalyzerSpec, ...] = (
    AnalyzerSpec("Digital Signature (C2PA)", "c2pa", _signed),
    AnalyzerSpec("SynthID Watermark", "synthid", _watermark),
    AnalyzerSpec("TinEye Reverse Search", "tineye", _backlinks),
    AnalyzerSpec("AI Metadata (EXIF)", "exif", _metadata),
    AnalyzerSpec("Human Consensus", "human", _human),
)
# A batch of URLs runs everything but the manual back-link search.
BATCH_ANALYZERS = tuple(s for s in ANALYZERS if s.slug != EVIDENCE_EXCLUDED)


def _run(spec: AnalyzerSpec, order: int, inputs: Inputs) -> DataFrame:
    try:
        rows = spec.transform(inputs)
    except AnalysisException as exc:  # tables that an analyzer cannot read are an error of that analyzer alone
        LOG.warning("analyzer %s cannot be planned: %s", spec.slug, exc)
        rows = inputs.queries.select(
            "query_id", F.lit("ERROR").alias("status"), F.lit(str(exc)).alias("summary"), F.lit("{}").alias("data")
        )
    return rows.select(
        "query_id", F.lit(order).cast("bigint").alias("ord"), F.lit(spec.slug).alias("slug"), F.lit(spec.name).alias("name"),
        F.coalesce("status", F.lit("UNKNOWN")).alias("status"), F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("data", F.lit("{}")).alias("data"),
    )


def run_analyzers(inputs: Inputs, analyzers: Sequence[AnalyzerSpec] = ANALYZERS, expired: DataFrame | None = None) -> DataFrame:
    """Rows of all analyzers in catalog order; queries in ``expired(query_id)`` get an error row per analyzer."""
    rows = reduce(DataFrame.unionByName, [_run(s, i, inputs) for i, s in enumerate(analyzers)])
    if expired is None:
        return rows
    gone = expired.select("query_id").distinct().withColumn("_gone", F.lit(True))
    flagged = rows.join(gone, "query_id", "left")
    off = F.col("_gone").isNotNull()
    return flagged.withColumns({
        "status": F.when(off, "ERROR").otherwise(F.col("status")),
        "summary": F.when(off, EXPIRED_SUMMARY).otherwise(F.col("summary")),
        "data": F.when(off, "{}").otherwise(F.col("data")),
    }).drop("_gone")


def run_analyzer(inputs: Inputs, slug: str, analyzers: Sequence[AnalyzerSpec] = ANALYZERS) -> DataFrame:
    """Rows of one analyzer; an unknown slug is a KeyError."""
    for i, spec in enumerate(analyzers):
        if spec.slug == slug:
            return _run(spec, i, inputs)
    raise KeyError(f"Unknown analyzer slug: {slug}")


# Stored rows ---------------------------------------------------------------------------------------------------------

def persistable(rows: DataFrame, mode_col: str = "mode") -> DataFrame:
    """Rows that may be stored: back-link rows only in ``derived`` mode."""
    return rows.filter((F.col("slug") != EVIDENCE_EXCLUDED) | (F.col(mode_col) == "derived"))


def write_rows(rows: DataFrame, path: str) -> None:
    """Append rows ``(analysis_id, slug, seq, row_json)``, partitioned by slug; later ``seq`` wins when read."""
    rows.select("analysis_id", "seq", "row_json", "slug").write.mode("append").partitionBy("slug").parquet(path)


ROW_SCHEMA = "status string, summary string, data string"


def latest_rows(rows: DataFrame) -> DataFrame:
    """Last written row per (analysis, slug). Map-side combined, so rewrites of a hot analysis stay cheap."""
    rest = [c for c in rows.columns if c not in ("analysis_id", "slug")]
    return rows.groupBy("analysis_id", "slug").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(
        "analysis_id", "slug", "r.*"
    )


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Latest stored rows; one whose JSON does not parse reads as absent."""
    stored = spark.read.schema("analysis_id bigint, seq bigint, row_json string, slug string").parquet(path)
    parsed = latest_rows(stored).withColumn("r", F.from_json("row_json", ROW_SCHEMA))
    whole = F.try_parse_json("row_json").isNotNull()
    return parsed.filter(whole & F.col("r").isNotNull()).select("analysis_id", "slug", "seq", "r.*")


def analyzer_matrix(analyses: DataFrame, stored: DataFrame, analyzers: Sequence[AnalyzerSpec] = ANALYZERS) -> DataFrame:
    """One row per analysis and catalog analyzer; what is not stored reads as NOT_RUN."""
    catalog = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(s.slug).alias("slug"), F.lit(s.name).alias("name"))
        for i, s in enumerate(analyzers)
    ])
    grid = analyses.select("analysis_id", F.explode(catalog).alias("c")).select("analysis_id", "c.*")
    have = stored.select("analysis_id", "slug", "status", "summary", "data", F.lit(True).alias("_have"))
    j = grid.join(have, ["analysis_id", "slug"], "left")
    there = F.col("_have").isNotNull()
    is_object = F.coalesce(F.trim("data").startswith("{"), F.lit(False))
    return j.select(
        "analysis_id", "ord", "slug", "name",
        F.when(there, F.coalesce("status", F.lit("UNKNOWN"))).otherwise("NOT_RUN").alias("status"),
        F.when(there, F.coalesce("summary", F.lit(""))).otherwise(NOT_RUN_SUMMARY).alias("summary"),
        F.when(there & is_object, F.col("data")).otherwise("{}").alias("data"),
    )


def evidence_summary(stored: DataFrame) -> DataFrame:
    """Status and text per analysis and analyzer for the evidence strip, without the back-link row."""
    status = F.upper(F.coalesce(F.nullif("status", F.lit("")), F.lit("LOADING")))
    fallback = F.lit("")
    for key, text in SUMMARY_FALLBACK.items():
        fallback = F.when(F.lower(status) == key, text).otherwise(fallback)
    rows = stored.filter(F.col("slug") != EVIDENCE_EXCLUDED)
    return rows.select(
        "analysis_id", "slug", status.alias("status"), F.coalesce(F.nullif("summary", F.lit("")), fallback).alias("summary")
    )


def evidence_notable(summary: DataFrame) -> DataFrame:
    """Whether an analysis has notable evidence."""
    return summary.groupBy("analysis_id").agg(
        F.bool_or(F.col("status").isin(*NOTABLE)).alias("has_notable_evidence"), F.count("*").alias("rows")
    )


def metadata_merge(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Shallow merge of ``updates(analysis_id, update)`` into ``base(analysis_id, metadata_json)`` maps.

    The update's value wins per key. A base that is missing or does not parse stays out.
    """
    stored = base.select("analysis_id", F.from_json("metadata_json", "map<string,string>").alias("m"))
    good = stored.filter(F.col("m").isNotNull())
    j = good.join(updates.select("analysis_id", F.col("update").alias("u")), "analysis_id", "left")
    update = F.coalesce("u", F.create_map().cast("map<string,string>"))
    kept = F.map_filter("m", lambda k, v: ~F.map_contains_key("u", k) | F.col("u").isNull())
    return j.select("analysis_id", F.map_concat(kept, update).alias("metadata"))


# Report --------------------------------------------------------------------------------------------------------------

def report_lines(analyses: DataFrame, matrix: DataFrame, direct: DataFrame, distant: DataFrame, generated_at: str, app_version: str) -> DataFrame:
    """Provenance reports as JSON lines ``(analysis_id, section, ord, line)``.

    ``matrix(analysis_id, ord, name, slug, status, summary, data)`` are rows as the analyzers give them, or as stored.
    ``distant(analysis_id, rank, ...)`` is read twice; a caller to whom it is dear hands in a written table.

    Each analysis has one ``report`` line: head, hashes, analyzers, direct traces and search links, all of bounded
    size, and the number of distant matches. Distant matches, of which there may be any number, follow as one line
    each in rank order. ``analyses`` columns: analysis_id, created_s, source, mime, width, height, crop_box, phash,
    whash, registry_id, public_url.
    """
    rows = matrix.groupBy("analysis_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "name", "slug", "status", "summary", "data"))).alias("analyzers")
    )
    own = direct.groupBy(F.col("image_id").alias("registry_id")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "kind", "title", "summary", "details"))).alias("direct_traces")
    )
    n = distant.groupBy("analysis_id").agg(F.count("*").alias("distant_match_count"))
    j = (
        analyses.join(rows, "analysis_id", "left").join(own, "registry_id", "left").join(n, "analysis_id", "left")
        .na.fill(0, ["distant_match_count"])
    )
    no_ord = F.transform("analyzers", lambda a: a.dropFields("ord"))
    traces = F.transform(
        F.coalesce("direct_traces", F.array().cast("array<struct<ord:bigint,kind:string,title:string,summary:string,details:array<string>>>")),
        lambda a: a.dropFields("ord"),
    )
    head = F.to_json(F.struct(
        F.lit(REPORT_VERSION).alias("report_version"), F.lit(app_version).alias("app_version"), F.lit(generated_at).alias("generated_at"),
        F.struct(
            F.col("analysis_id").alias("id"), X.iso_utc(F.col("created_s")).alias("created_at"), "source", "mime",
            F.struct("width", "height").alias("dimensions"), B.as_struct(F.col("crop_box")).alias("crop_box"),
        ).alias("analysis"),
        F.struct("phash", "whash", "registry_id").alias("hashes"), no_ord.alias("analyzers"), traces.alias("direct_traces"),
        "distant_match_count",
        F.array(F.struct(F.lit("Reverse Image Search").alias("name"), U.search_links(F.col("public_url")).alias("links"))).alias("tools"),
    ), {"ignoreNullFields": "false"})
    reports = j.select("analysis_id", F.lit("report").alias("section"), F.lit(0).cast("bigint").alias("ord"), head.alias("line"))
    fields = [c for c in distant.columns if c not in ("analysis_id", "rank")]
    matches = distant.select(
        "analysis_id", F.lit("distant_match").alias("section"), F.col("rank").alias("ord"),
        F.to_json(F.struct("rank", *fields), {"ignoreNullFields": "false"}).alias("line"),
    )
    return reports.unionByName(matches)


def write_reports(lines: DataFrame, path: str) -> None:
    """Write report lines as JSON text, one folder per section."""
    lines.select("line", "section").write.mode("overwrite").partitionBy("section").text(path)


def report_matches(distant: DataFrame) -> DataFrame:
    """What a report shows of each distant trace, for ``report_lines``; from ``distant_traces`` with distances."""
    return distant.select(
        F.col("query_id").alias("analysis_id"), "rank", F.col("neighbor_id").alias("image_id"),
        F.col("neighbor_phash").alias("phash"), F.col("neighbor_whash").alias("whash"),
        X.iso_utc(F.unix_seconds("neighbor_created_at")).alias("created_at"), "phash_distance", "whash_distance", "distance", "hash_display",
        "match_method", H.method_label(F.col("match_method")).alias("match_method_label"), "c2pa_facts", "vote_real", "vote_edited", "vote_ai",
        "total_votes", "detected", "not_detected",
    )
