"""Donation totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.functions import texts as T

GOAL_CENTS = 20_000


def donation_total(payments: DataFrame) -> DataFrame:
    """Sum of the positive cents of ``payments(amount)`` as one row."""
    cents = payments.select(T.amount_to_cents(F.col("amount")).alias("cents")).filter("cents > 0")
    return cents.agg(F.coalesce(F.sum("cents"), F.lit(0)).cast("bigint").alias("total_cents"))


def donation_progress(total: DataFrame) -> DataFrame:
    """Share of the goal in percent and whether it is met."""
    share = F.least(F.col("total_cents") / GOAL_CENTS, F.lit(1.0))
    return total.withColumns({
        "progress_percent": F.round(share * 100, 2), "goal_met": F.col("total_cents") >= GOAL_CENTS,
    })
