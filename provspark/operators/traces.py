"""Evidence trails: what an image carries itself and what its neighbors carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.functions import texts as X
from provspark.operators.skew import sliced_row_number, top_per_key

# Order of match methods, list sizes and labels.
METHOD_ORDER = {"hybrid": 0, "local": 1, "hash": 2}
SHOWN_SOURCES = 3
DETECTOR_LABELS = {"google_about_this_image": "Google", "openai_verify": "OpenAI"}
DAY_SECONDS = 86_400


def neighbor_details(neighbors: DataFrame, votes: DataFrame, sources: DataFrame, facts: DataFrame,
                     reports: DataFrame) -> DataFrame:
    """Counts known about each neighbor; every side table is reduced to one row per image before it is joined."""
    def per_image(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy(F.col("image_id").alias("neighbor_id")).agg(F.count("*").alias(out))

    def renamed(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("image_id", "neighbor_id")

    named = sources.filter("url <> ''")
    return (
        neighbors.join(renamed(votes), "neighbor_id", "left").join(per_image(named, "source_count"), "neighbor_id", "left")
        .join(per_image(facts, "fact_count"), "neighbor_id", "left").join(renamed(reports), "neighbor_id", "left")
        .na.fill(0, ["source_count", "fact_count"])
    )


def neighbor_evidence(neighbors: DataFrame, sources: DataFrame, facts: DataFrame) -> DataFrame:
    """All sources and facts of each neighbor in long form ``(query_id, neighbor_id, kind, item)``."""
    items = sources.filter("url <> ''").select(
        F.col("image_id").alias("neighbor_id"), F.lit("source").alias("kind"), F.col("url").alias("item")
    ).unionByName(facts.filter("analyzer is not null and data is not null").select(
        F.col("image_id").alias("neighbor_id"), F.concat(F.lit("fact:"), "analyzer").alias("kind"), F.col("data").alias("item")
    ))
    return neighbors.select("query_id", "neighbor_id").join(items, "neighbor_id")


def top_sources(sources: DataFrame, shown: int = SHOWN_SOURCES) -> DataFrame:
    """First source URLs per image in URL order; an empty one takes a place and is then dropped."""
    return top_per_key(sources, ["image_id"], [F.asc("url")], shown, "rank").filter("url <> ''")


def carried_evidence(votes: DataFrame, facts: DataFrame, reports: DataFrame) -> DataFrame:
    """What each image carries: signed facts, votes, reports, and how many of these kinds; images without any are left out."""
    signed = facts.filter("analyzer = 'c2pa'").groupBy("image_id").agg(F.count("*").alias("c2pa_facts"))
    voted = votes.withColumn("total_votes", F.expr("vote_real + vote_edited + vote_ai")).filter("total_votes > 0")
    told = reports.filter("detected + not_detected > 0")
    carried = voted.join(signed, "image_id", "full").join(told, "image_id", "full")
    kinds = sum((F.col(c).isNotNull().cast("bigint") for c in ("c2pa_facts", "total_votes", "detected")), F.lit(0))
    return carried.withColumn("kinds", kinds)


def distant_traces(neighbors: DataFrame, carried: DataFrame) -> DataFrame:
    """Other neighbors that carry evidence, ranked per query.

    Order: match method, number of kinds carried, newer first, neighbor id. The rank is taken in slices, so a query
    with very many neighbors does not sort in one task.
    """
    rows = neighbors.filter(~F.col("is_self_match")).join(carried.withColumnRenamed("image_id", "neighbor_id"), "neighbor_id")
    order = F.lit(99)
    for name, i in METHOD_ORDER.items():
        order = F.when(F.col("match_method") == name, F.lit(i)).otherwise(order)
    created = F.coalesce(F.unix_micros("neighbor_created_at"), F.lit(0))
    ranked = sliced_row_number(
        rows, ["query_id"], [order, -F.col("kinds"), -F.floor(created / (DAY_SECONDS * 1_000_000))],
        [created.desc(), F.col("neighbor_id").asc()], "rank",
    )
    return ranked.withColumn("distance", F.when(F.col("match_method") != "local", F.col("display_distance")))


def direct_traces(images: DataFrame, facts: DataFrame, votes: DataFrame, by_detector: DataFrame,
                  metadata_status: DataFrame, shown_facts: int | None = None) -> DataFrame:
    """Up to four items per image: signed facts, votes, reports, AI metadata, each with text and details.

    ``metadata_status(image_id, status, finding_count)``. Details list all signed facts, or the first ``shown_facts``.
    """
    signed = facts.filter("analyzer = 'c2pa'")
    n_facts = signed.groupBy("image_id").agg(F.count("*").alias("n"))
    first = (
        (signed if shown_facts is None else top_per_key(signed, ["image_id"], [F.asc("data")], shown_facts, "rn"))
        .groupBy("image_id").agg(F.array_sort(F.collect_list("data")).alias("details"))
    )
    none = F.array().cast("array<string>")
    n = F.col("n")

    def item(df: DataFrame, ord_: int, kind: str, title: str, summary, details) -> DataFrame:
        return df.select(
            "image_id", F.lit(ord_).cast("bigint").alias("ord"), F.lit(kind).alias("kind"), F.lit(title).alias("title"),
            summary.alias("summary"), details.alias("details"),
        )

    c2pa = item(n_facts.join(first, "image_id"), 0, "c2pa", "Direct C2PA",
                F.concat(n, F.lit(" direct C2PA fact"), X.plural(n), F.lit(".")), F.col("details"))
    v = votes.withColumn("n", F.expr("vote_real + vote_edited + vote_ai")).filter("n > 0")
    human = item(v, 1, "human", "Direct Consensus", F.concat(
        n, F.lit(" vote"), X.plural(n), F.lit(": "), "vote_real", F.lit(" real / "), "vote_edited", F.lit(" edited / "),
        "vote_ai", F.lit(" AI.")), none)
    label = F.replace(F.col("detector"), F.lit("_"), F.lit(" "))
    for name, text in DETECTOR_LABELS.items():
        label = F.when(F.col("detector") == name, text).otherwise(label)
    line = F.concat(label, F.lit(": "), "detected", F.lit(" detected / "), "not_detected", F.lit(" not detected"))
    # Few detectors exist, so the per-image list of their lines is short.
    rep = by_detector.filter("total > 0").groupBy("image_id").agg(
        F.sum("total").alias("n"), F.sum("detected").alias("d"), F.sum("not_detected").alias("x"),
        F.transform(F.array_sort(F.collect_list(F.struct("detector", line.alias("line")))), lambda s: s["line"]).alias("details"),
    )
    synthid = item(rep, 2, "synthid", "Direct SynthID Reports", F.concat(
        n, F.lit(" report"), X.plural(n), F.lit(": "), "d", F.lit(" detected / "), "x", F.lit(" not detected.")),
        F.col("details"))
    m = metadata_status.filter(F.upper("status") == "FOUND").withColumn("n", F.col("finding_count"))
    exif = item(m, 3, "exif", "Direct AI Metadata",
                F.concat(n, F.lit(" metadata finding"), X.plural(n), F.lit(".")), none)
    items = c2pa.unionByName(human).unionByName(synthid).unionByName(exif)
    return items.join(images.select("image_id"), "image_id", "left_semi")
