"""Request quotas: which requests of a log lie above the number allowed per fixed window."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.operators.skew import time_slice, top_per_key


@dataclass(frozen=True)
class Quota:
    """At most ``limit`` requests per window of ``seconds``, per key or over all keys."""

    name: str
    limit: int
    seconds: int
    per_key: bool


# The limits of the public endpoints.
REVERSE_SEARCH = (Quota("reverse_search_key_hour", 5, 3600, True), Quota("reverse_search_hour", 100, 3600, False))
BATCH = (Quota("batch_minute", 3, 60, True),)
LOOKUP = (Quota("lookup_minute", 30, 60, True), Quota("lookup_hour", 500, 3600, False))


def over_quota(requests: DataFrame, quotas: tuple[Quota, ...]) -> DataFrame:
    """Requests ``(event_id, key, ts)`` beyond a quota, once per quota they exceed.

    The allowed requests of a window are a top-n, pruned before the shuffle; the last of them is the cut-off every
    request of that window is compared with. So a window with very many requests is never sorted in one task.
    """
    parts = []
    for q in quotas:
        rows = requests.select(
            "event_id", "ts", F.col("key").alias("request_key"), time_slice(F.col("ts"), q.seconds).alias("window_no"),
            (F.col("key").cast("string") if q.per_key else F.lit("global")).alias("scope"),
        )
        keys = ["scope", "window_no"]
        last = (
            top_per_key(rows, keys, [F.asc("ts"), F.asc("event_id")], q.limit, "rn")
            .filter(F.col("rn") == q.limit).select(*keys, F.struct("ts", "event_id").alias("cut"))
        )
        parts.append(
            rows.join(last, keys).filter(F.struct("ts", "event_id") > F.col("cut"))
            .select(F.lit(q.name).alias("quota"), "event_id", "request_key", "scope",
                    (F.col("window_no") * q.seconds).alias("window_start_s"))
        )
    return reduce(DataFrame.unionByName, parts)
