"""Analytics over reverse-search back-links ``(image_id, ord, url, domain, crawl_date, similarity)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provspark.functions import texts as X
from provspark.functions import urls as U
from provspark.operators.skew import top_per_key

# Similarity threshold, list sizes, timeline labels.
SIMILARITY_THRESHOLD = 0.70
TOP_DOMAINS = 5
SHOWN_MATCHES = 5
TIMELINE_BINS = ("pre-2020", "2020-2022", "2023+")

RESPONSE_SCHEMA = T.StructType([
    T.StructField("code", T.LongType()),
    T.StructField("messages", T.ArrayType(T.StringType())),
    T.StructField("results", T.StructType([
        T.StructField("total_results", T.LongType()),
        T.StructField("matches", T.ArrayType(T.StructType([
            T.StructField("score", T.DoubleType()),
            T.StructField("domain", T.StringType()),
            T.StructField("backlinks", T.ArrayType(T.StructType([
                T.StructField("url", T.StringType()),
                T.StructField("backlink", T.StringType()),
                T.StructField("crawl_date", T.StringType()),
            ]))),
        ]))),
    ])),
])


def parse_responses(dump: DataFrame) -> DataFrame:
    """Responses ``(image_id, response_json)`` with success flag, error text and total; matches stay nested."""
    r = F.col("r")
    ok = F.coalesce(r["code"] == 200, F.lit(False))
    messages = F.coalesce(r["messages"], F.array(F.lit("Unknown error")))
    return dump.select("image_id", F.from_json("response_json", RESPONSE_SCHEMA).alias("r")).select(
        "image_id", ok.alias("success"), F.when(~ok, F.array_join(messages, "; ")).alias("error"),
        F.when(ok, F.coalesce(r["results"]["total_results"], F.lit(0))).otherwise(0).cast("bigint").alias("total_matches"),
        F.when(ok, r["results"]["matches"]).alias("matches"),
    )


def response_matches(parsed: DataFrame) -> DataFrame:
    """One row per match: the first back-link's URL and crawl date, and the score as a share."""
    m, link = F.col("m"), F.get(F.col("m.backlinks"), F.lit(0))
    url = F.coalesce(F.nullif(link["url"], F.lit("")), link["backlink"], F.lit(""))
    return parsed.select("image_id", F.posexplode("matches").alias("ord", "m")).select(
        "image_id", F.col("ord").cast("bigint").alias("ord"), url.alias("url"), F.coalesce(m["domain"], F.lit("")).alias("domain"),
        F.when(F.coalesce(link["crawl_date"], F.lit("")) == "", "").otherwise(X.crawl_date_iso(link["crawl_date"])).alias("crawl_date"),
        (F.coalesce(m["score"], F.lit(0.0)) / 100).alias("similarity"),
    )


def similarity_filter(matches: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    return matches.filter(F.col("similarity") >= threshold)


def _dom() -> Column:
    return U.domain(F.col("domain"), F.col("url"))


def domain_counts(matches: DataFrame, top: int = TOP_DOMAINS) -> DataFrame:
    """Most frequent domains per image, ties by name."""
    counts = (
        matches.select("image_id", _dom().alias("domain")).filter("domain <> ''")
        .groupBy("image_id", "domain").agg(F.count("*").alias("matches"))
    )
    return top_per_key(counts, ["image_id"], [F.desc("matches"), F.asc("domain")], top, "rank")


def category_counts(matches: DataFrame) -> DataFrame:
    """Matches per image and domain category, with their order."""
    counts = (
        matches.select("image_id", _dom().alias("d")).filter("d <> ''")
        .select("image_id", U.domain_category(F.col("d")).alias("category"))
        .groupBy("image_id", "category").agg(F.count("*").alias("matches"))
    )
    order = Window.partitionBy("image_id").orderBy(F.desc("matches"), F.asc("category"))
    return counts.withColumn("rank", F.row_number().over(order))  # a row for each of few categories


def timeline_counts(images: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches per image and period; all three periods are always there."""
    bins = matches.select("image_id", X.timeline_bin(X.crawl_year(F.col("crawl_date"))).alias("b"))
    counts = bins.groupBy("image_id").agg(*[F.count_if(F.col("b") == b).alias(f"n{i}") for i, b in enumerate(TIMELINE_BINS)])
    rows = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(b).alias("label"), F.coalesce(f"n{i}", F.lit(0)).alias("matches"))
        for i, b in enumerate(TIMELINE_BINS)
    ])
    return images.select("image_id").join(counts, "image_id", "left").select("image_id", F.explode(rows).alias("s")).select(
        "image_id", "s.*"
    )


def oldest_newest(matches: DataFrame, shown: int = SHOWN_MATCHES) -> DataFrame:
    """The oldest and newest dated matches per image as ``(image_id, bucket, rank, ord, url, domain, crawl_date)``.

    Dates compare as text. With more than ``shown`` dated matches the newest leave out what equals an oldest match in
    URL, domain and date. Both ends are top-n reads, pruned before the shuffle.
    """
    dated = matches.filter("crawl_date <> ''").select("image_id", "ord", "url", "domain", "crawl_date")
    old = top_per_key(dated, ["image_id"], [F.asc("crawl_date"), F.asc("ord")], shown, "rank")
    new = top_per_key(dated, ["image_id"], [F.desc("crawl_date"), F.desc("ord")], shown, "rank")
    sizes = dated.groupBy("image_id").agg((F.count("*") > shown).alias("_many"))
    identity = ["image_id", "url", "domain", "crawl_date"]
    new_all = new.join(sizes, "image_id")
    few = new_all.filter(~F.col("_many")).drop("_many")
    many = new_all.filter("_many").drop("_many").join(old.select(*identity).distinct(), identity, "left_anti")
    kept = few.unionByName(many)
    # At most ``shown`` rows per image are left, so renumbering them is a small window.
    kept = top_per_key(kept.drop("rank"), ["image_id"], [F.desc("crawl_date"), F.desc("ord")], shown, "rank")
    return old.withColumn("bucket", F.lit("oldest")).unionByName(kept.withColumn("bucket", F.lit("newest")))


def summary(images: DataFrame, matches: DataFrame, listed: DataFrame) -> DataFrame:
    """Counts, earliest date, block-list flag, status and text per image.

    ``images(image_id, total_matches)``; ``listed`` are the matches found on the block list (any columns + image_id).
    """
    good = similarity_filter(matches)
    sums = good.groupBy("image_id").agg(
        F.count("*").alias("filtered_match_count"), F.min(F.nullif("crawl_date", F.lit(""))).alias("earliest_date")
    )
    flagged = similarity_filter(listed).select("image_id").distinct().withColumn("on_blocklist", F.lit(True))
    out = (
        images.join(sums, "image_id", "left").join(flagged, "image_id", "left")
        .na.fill(0, ["filtered_match_count"]).na.fill({"on_blocklist": False})
    )
    shown = F.when(F.col("filtered_match_count") > 0, F.col("filtered_match_count")).otherwise(F.col("total_matches"))
    when = F.date_format(F.try_to_timestamp("earliest_date"), "MMM yyyy")
    text = F.concat(
        shown, F.lit(" matches found."), F.coalesce(F.concat(F.lit(" Earliest: "), when, F.lit(".")), F.lit("")),
        F.when(F.col("on_blocklist"), " ⚠️ Found on AI image sites.").otherwise(" Not on known AI sites."),
    )
    return out.withColumns({
        "status": F.when(F.col("filtered_match_count") > 0, "FOUND").otherwise("NOT FOUND"),
        "summary": F.when(shown == 0, "No matches found.").otherwise(text),
    })
