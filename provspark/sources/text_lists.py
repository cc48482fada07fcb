"""Line-based inputs: batches of URLs and pattern lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions import texts as X

# Texts, length of the label of a refused line.
INVALID_URL = "Invalid URL format"
LABEL_CHARS = 60


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(batch_id, pos, line)``: one batch per file.

    ``pos`` orders the lines of a file: where its split starts, then a number that grows along the split. Large files
    are read in splits like any other.
    """
    lines = spark.read.text(path)
    pos = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("_metadata.file_path").alias("batch_id"), pos.alias("pos"), F.col("value").alias("line"))


def url_batches(lines: DataFrame, cap: int | None = None) -> DataFrame:
    """URLs to process per batch of ``lines(batch_id, pos, line)``.

    Lines are trimmed and blank ones dropped. Lines that are no http(s) URL keep an error row; of equal URLs the first is
    kept. Sort by ``pos`` for the given order. With a ``cap``, a batch of more lines is refused as a whole (one row).
    """
    rows = lines.select("batch_id", "pos", X.strip(F.col("line")).alias("url")).filter("url <> ''")
    fits, over = rows, None
    if cap is not None:
        over = rows.groupBy("batch_id").agg(F.count("*").alias("n")).filter(F.col("n") > cap)
        fits = rows.join(over, "batch_id", "left_anti")
    good = F.col("url").rlike("^https?://")
    bad_rows = fits.filter(~good).select(
        "batch_id", "pos", "url", F.lit(INVALID_URL).alias("error"), F.substring("url", 1, LABEL_CHARS).alias("label")
    )
    kept = fits.filter(good).groupBy("batch_id", "url").agg(F.min("pos").alias("pos")).select(
        "batch_id", "pos", "url", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("label")
    )
    if over is None:
        return kept.unionByName(bad_rows)
    refused = over.select(
        "batch_id", F.lit(None).cast(lines.schema["pos"].dataType).alias("pos"), F.lit(None).cast("string").alias("url"),
        F.lit(f"Maximum {cap} URLs per batch.").alias("error"), F.lit(None).cast("string").alias("label"),
    )
    return kept.unionByName(bad_rows).unionByName(refused)
