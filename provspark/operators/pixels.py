"""Analyses over pixel tables: crop quality and text banners at image edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provspark.functions import boxes as B

# Banner detection.
MIN_WIDTH_COVERAGE = 0.80
MAX_BANNER_SHARE = 0.30
MIN_BANNER_ROWS = 8
THRESHOLD_STDS = 2.5
THRESHOLD_FLOOR = 5.0
MIN_CONFIDENCE = 0.50
MIN_SIDE = 40
MIN_KEPT_SHARE = 0.10
INTERIOR = (0.20, 0.80)
PIXEL_SHARE_OF_THRESHOLD = 0.30


def crop_quality(pixels: DataFrame) -> DataFrame:
    """Entropy and contrast per crop of ``pixels(crop_id, value)`` and whether it is detailed enough.

    Two combinable aggregations: the histogram (at most 256 rows per crop), then its moments.
    """
    hist = pixels.groupBy("crop_id", "value").agg(F.count("*").alias("n"))
    n, v = F.col("n").cast("double"), F.col("value").cast("double")
    m = hist.groupBy("crop_id").agg(
        F.sum("n").alias("total"), F.sum(n * F.log2(n)).alias("nlogn"), F.sum(n * v).alias("s1"), F.sum(n * v * v).alias("s2")
    )
    mean = F.col("s1") / F.col("total")
    entropy = F.log2("total") - F.col("nlogn") / F.col("total")
    contrast = F.sqrt(F.greatest(F.col("s2") / F.col("total") - mean * mean, F.lit(0.0)))
    out = m.select("crop_id", "total", entropy.alias("entropy"), contrast.alias("contrast"))
    return out.withColumn(
        "accepted", (F.col("entropy") >= B.MIN_CROP_ENTROPY) | (F.col("contrast") >= B.MIN_CROP_CONTRAST)
    )


def _smooth_row(px: Column) -> Column:
    """1-2-1 smoothing along a row, mirrored at the ends without repeating the edge pixel."""
    n = F.size(px)
    left = F.concat(F.slice(px, 2, 1), F.slice(px, F.lit(1), n - 1))
    right = F.concat(F.slice(px, F.lit(2), n - 1), F.slice(px, n - 1, F.lit(1)))
    sides = F.zip_with(left, right, lambda a, b: a + b)
    return F.zip_with(sides, px, lambda s, p: s + 2 * p)


def vertical_gradient(rows: DataFrame) -> DataFrame:
    """Absolute vertical Sobel gradient of luma rows ``(image_id, y, px)``; the outermost rows are 0 by mirroring.

    The window holds one image at a time, whose height bounds it.
    """
    smooth = rows.select("image_id", "y", _smooth_row(F.col("px")).alias("s"))
    w = Window.partitionBy("image_id").orderBy("y")
    both = smooth.select("image_id", "y", "s", F.lag("s").over(w).alias("above"), F.lead("s").over(w).alias("below"))
    flat = F.transform("s", lambda x: F.lit(0).cast("bigint"))
    grad = F.zip_with("below", "above", lambda b, a: F.abs(b - a).cast("bigint"))
    return both.select("image_id", "y", F.coalesce(grad, flat).alias("grad"))


def banner_rows(rows: DataFrame) -> DataFrame:
    """Per image whether text banners sit at its top or bottom edge and the box that leaves them out."""
    total = F.aggregate("grad", F.lit(0).cast("bigint"), lambda a, x: a + x)
    g = vertical_gradient(rows).withColumn("mean", total / F.size("grad"))
    size = g.groupBy("image_id").agg((F.max("y") + 1).alias("h"), F.max(F.size("grad")).alias("w"))
    g = g.join(size, "image_id")
    h, y = F.col("h"), F.col("y")
    inside = (y >= F.floor(h * INTERIOR[0])) & (y < F.floor(h * INTERIOR[1]))
    base = g.groupBy("image_id").agg(
        F.percentile(F.when(inside, F.col("mean")), 0.5).alias("median"),
        F.stddev_pop(F.when(inside, F.col("mean"))).alias("std"),
    ).select("image_id", F.greatest(F.lit(THRESHOLD_FLOOR), F.col("median") + THRESHOLD_STDS * F.col("std")).alias("thr"))
    g = g.join(base, "image_id")
    wide = F.size(F.filter("grad", lambda x: x > F.col("thr") * PIXEL_SHARE_OF_THRESHOLD)) / F.size("grad")
    hit = (F.col("mean") > F.col("thr")) & (wide >= MIN_WIDTH_COVERAGE)
    low_zone = hit & (y >= F.floor(h * (1.0 - MAX_BANNER_SHARE)))
    top_zone = hit & (y < F.floor(h * MAX_BANNER_SHARE) + 1)
    edge = g.groupBy("image_id", "h", "w", "thr").agg(
        F.min(F.when(low_zone, F.struct("y", "mean"))).alias("bottom"),
        F.max(F.when(top_zone, F.struct("y", "mean"))).alias("top"),
    )
    thr = F.col("thr")

    def confidence(c: Column) -> Column:
        return B.clamp01((c["mean"] - thr) / (thr + 1e-6))

    bottom = F.when(F.col("h") - F.col("bottom.y") >= MIN_BANNER_ROWS, F.col("bottom"))
    top = F.when(F.col("top.y") + 1 >= MIN_BANNER_ROWS, F.col("top"))
    e = edge.withColumns({"bottom": bottom, "top": top})
    has_b, has_t = F.col("bottom").isNotNull(), F.col("top").isNotNull()
    e = e.withColumns({
        "top_share": F.coalesce((F.col("top.y") + 1) / F.col("h"), F.lit(0.0)),
        "bottom_share": F.coalesce(F.col("bottom.y") / F.col("h"), F.lit(1.0)),
        "conf": F.greatest(
            F.coalesce(confidence(F.col("top")), F.lit(0.0)), F.coalesce(confidence(F.col("bottom")), F.lit(0.0))
        ),
    })
    kept = F.col("bottom_share") - F.col("top_share")
    big = (F.col("h") >= MIN_SIDE) & (F.col("w") >= MIN_SIDE)
    candidate = big & (has_b | has_t) & (kept > MIN_KEPT_SHARE)
    found = candidate & (F.col("conf") >= MIN_CONFIDENCE)
    method = F.concat(
        F.lit("Detected: "),
        F.array_join(F.array_compact(F.array(
            F.when(has_t, "top text banner"), F.when(has_b, "bottom text banner"))), " and "),
    )
    return e.select(
        "image_id", found.alias("has_overlay"), F.when(candidate, F.col("conf")).otherwise(0.0).alias("confidence"),
        F.when(found, F.array(F.lit(0.0), F.col("top_share"), F.lit(1.0), kept)).alias("crop_box"),
        F.when(found, method).otherwise("").alias("method"),
    )
