"""Window-like results computed without putting a whole key into one task.

A plain window sends every row of a key to one task. The helpers here cut a key into slices first, work inside each
slice, and carry one summary row per slice across, so the largest task holds one slice of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_SLICE_SECONDS = 3600


def time_slice(ts: Column, seconds: int = DEFAULT_SLICE_SECONDS) -> Column:
    """Number of the fixed-width time slice a timestamp falls into."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def sliced_lag(df: DataFrame, keys: list[str], slice_col: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the latest non-null value among the earlier rows of the same key in ``order``.

    ``slice_col`` must be non-decreasing along ``order``.
    """
    def before(window):
        return window.rowsBetween(Window.unboundedPreceding, -1)

    inside = before(Window.partitionBy(*keys, slice_col).orderBy(*order))
    within = df.withColumn("_lag", F.last(value, ignorenulls=True).over(inside))
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    last = df.groupBy(*keys, slice_col).agg(F.max_by(value, known).alias("_last"))
    across = before(Window.partitionBy(*keys).orderBy(slice_col))
    carry = last.select(*keys, slice_col, F.last("_last", ignorenulls=True).over(across).alias("_carry"))
    joined = within.join(carry, [*keys, slice_col], "left")
    return joined.withColumn(out, F.coalesce("_lag", "_carry")).drop("_lag", "_carry")


def sliced_row_number(df: DataFrame, keys: list[str], slices: list[Column], order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the 1-based position of each row of a key under ``slices + order``.

    ``slices`` are the leading sort expressions with few distinct values per key; only rows that agree on all of them
    meet in one task.
    """
    names = [f"_s{i}" for i in range(len(slices))]
    cut = df.select("*", *[s.alias(n) for s, n in zip(slices, names)])
    sizes = cut.groupBy(*keys, *names).agg(F.count("*").alias("_n"))
    before = (
        Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(*keys, *names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    numbered = cut.withColumn("_rn", F.row_number().over(inside))
    same = [numbered[k] == offsets[k] for k in keys] + [numbered[n].eqNullSafe(offsets[n]) for n in names]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = numbered.join(offsets.select(*[F.col(c) for c in (*keys, *names, "_before")]), cond, "inner")
    return joined.select(*[numbered[c] for c in df.columns], (F.col("_rn") + F.col("_before")).cast("bigint").alias(out))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str) -> DataFrame:
    """First ``n`` rows per key; Spark prunes each map-side partition to ``n`` rows before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= n)


def dense_ids(df: DataFrame, key: str, start: Column | int, out: str, digits: int = 4) -> DataFrame:
    """Number rows of a unique key 1, 2, 3, ... after ``start`` without a single-task sort.

    Keys are spread over ``16 ** digits`` groups by a digest prefix; group sizes give each group its offset. The
    offset table has at most that many rows, so it is broadcast.
    """
    grouped = df.withColumn("_g", F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, digits))
    sizes = grouped.groupBy("_g").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    start = F.lit(start) if isinstance(start, int) else start
    inside = Window.partitionBy("_g").orderBy(key)
    return (
        grouped.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_g")
        .withColumn(out, (start + F.col("_before") + F.col("_rn")).cast("bigint"))
        .drop("_g", "_rn", "_before")
    )
