"""Structured Streaming jobs over folders of event files. Each must end in the state its batch counterpart computes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from provspark.functions import texts as X
from provspark.operators.ledger import VOTE_CHOICES
from provspark.operators.quotas import Quota
from provspark.operators.skew import time_slice, top_per_key

VOTE_STATE = "image_id bigint, voter_id string, choice string, ts timestamp, event_id bigint"
REQUEST = "scope string, window_no bigint, ts timestamp, event_id bigint, request_key bigint"
#: So many runs of updates of one length are merged into the next longer one.
FAN = 4


def read_events(spark: SparkSession, folder: str, glob: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, in order of arrival."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def vote_states(events: DataFrame, known_images: DataFrame, delay: str | None = None) -> DataFrame:
    """Newest valid choice of each (image, voter) of known images, in update mode.

    The registry is joined as a table, so an event counts if its image is known when the event is read. The state is one
    row per key, held and combined by Spark's own aggregation. With a ``delay``, an event id that comes again is dropped
    as long as the watermark has not passed it, and so are events older than the watermark; without, repeated events are
    combined and change nothing.
    """
    valid = events.filter(F.col("choice").isin(*VOTE_CHOICES)).join(known_images.select("image_id"), "image_id", "left_semi")
    valid = valid.withColumn("ts", F.col("ts").cast("timestamp"))
    if delay:
        valid = valid.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    newest = F.max(F.struct("ts", "event_id", "choice")).alias("s")
    return valid.groupBy("image_id", "voter_id").agg(newest).select("image_id", "voter_id", "s.choice", "s.ts", "s.event_id")


def _complete(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the finished folders ``prefix=...`` under a path of any file system."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    return [n for n in names if n.startswith(f"{prefix}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def _remove(spark: SparkSession, path: str, names: list[str]) -> None:
    for n in names:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def update_runs(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The runs ``run=first-last`` of batches that hold all updates, and those that longer ones have replaced."""
    spans = sorted((int(a), -int(b), n) for n in _complete(spark, path, "run") for a, b in [n[4:].split("-")])
    held, replaced, at = [], [], 0
    for first, last, n in spans:  # of equal beginnings the longest comes first
        if first >= at:
            held.append(n)
            at = 1 - last
        else:
            replaced.append(n)
    return held, replaced


def newest_rows(rows: DataFrame) -> DataFrame:
    newest = F.max(F.struct("ts", "event_id", "choice")).alias("s")
    return rows.groupBy("image_id", "voter_id").agg(newest).select("image_id", "voter_id", "s.choice", "s.ts", "s.event_id")


def run_updates_to_files(stream: DataFrame, path: str, checkpoint: str, fan: int = FAN) -> None:
    """Process everything available; the changed rows of a batch are a run of updates, and ``fan`` runs of one length are
    merged into one, so a row is rewritten a logarithmic number of times and there are few runs at any time.

    A run's name tells its batches and its content depends on them alone: a batch that is repeated after a failure writes
    the same runs again. A replaced run stays for readers until the next batch begins.
    """
    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _remove(spark, path, update_runs(spark, path)[1])
        batch.write.mode("overwrite").parquet(f"{path}/run={number}-{number}")
        length = fan
        while (number + 1) % length == 0:
            first = number + 1 - length
            parts = [f"{path}/run={a}-{a + length // fan - 1}" for a in range(first, number + 1, length // fan)]
            done = f"run={first}-{number}"
            if done not in _complete(spark, path, "run"):
                newest_rows(spark.read.schema(VOTE_STATE).parquet(*parts)).write.mode("overwrite").parquet(f"{path}/{done}")
            length *= fan

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each (image, voter) among the updates of all batches."""
    runs = update_runs(spark, path)[0]
    rows = spark.read.schema(VOTE_STATE).parquet(*[f"{path}/{n}" for n in runs]) if runs else spark.createDataFrame([], VOTE_STATE)
    return newest_rows(rows).select("image_id", "voter_id", "choice")


def run_quota_flags(requests: DataFrame, quota: Quota, path: str, checkpoint: str, delay_s: int = 600) -> None:
    """Process the available requests ``(event_id, key, ts)``; those above the quota go to ``path``, each as soon as it is known.

    What is kept of a window are its first ``limit`` requests by (ts, event_id). They come from those kept before and the
    batch's own, first within each task and then merged, so neither a window nor a batch is gathered in one task. A
    request that is not among them, or no longer, lies above the quota for good. Windows that end at or before the watermark
    (greatest ts of earlier batches less ``delay_s``) leave the state, and later requests for them are dropped. Event ids
    are unique. State and flags of a batch are folders of its number; a batch that is repeated writes the same again.
    """
    keys = ["scope", "window_no"]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(REQUEST).parquet(f"{path}/state={number - 1}") if number else spark.createDataFrame([], REQUEST)
        mark = spark.read.schema("mark timestamp").parquet(f"{path}/mark={number - 1}").first()[0] if number else None
        fresh = batch.select(
            (F.col("key").cast("string") if quota.per_key else F.lit("global")).alias("scope"), time_slice(F.col("ts"), quota.seconds).cast("bigint").alias("window_no"),
            F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("bigint").alias("event_id"), F.col("key").cast("bigint").alias("request_key")).where("ts is not null")
        rows = before.unionByName(fresh)
        if mark is not None:
            rows = rows.where((F.col("window_no") + 1) * quota.seconds > F.unix_micros(F.lit(mark)) / 1e6 - delay_s)
        rows = rows.persist()
        try:
            top_per_key(rows, keys, [F.asc("ts"), F.asc("event_id")], quota.limit, "rn").select("scope", "window_no", "ts", "event_id", "request_key") \
                .write.mode("overwrite").parquet(f"{path}/state={number}")
            kept = spark.read.schema(REQUEST).parquet(f"{path}/state={number}")
            last = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id")).alias("cut")).where(F.col("n") == quota.limit).drop("n")
            rows.join(last, keys).where(F.struct("ts", "event_id") > F.col("cut")).drop("cut").write.mode("overwrite").parquet(f"{path}/flags={number}")
            seen = fresh.agg(F.max("ts").alias("t")).select(F.greatest("t", F.lit(mark).cast("timestamp")).alias("mark"))
            seen.write.mode("overwrite").parquet(f"{path}/mark={number}")
        finally:
            rows.unpersist()
        old = [n for kind in ("state", "mark") for n in _complete(spark, path, kind) if int(n.split("=")[1]) < number - 1]
        _remove(spark, path, old)

    requests.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


def settled_flags(spark: SparkSession, path: str, quota: Quota, delay_s: int = 600) -> DataFrame:
    """Flags of the windows that the watermark has passed; those of open windows hold as well, but more may follow."""
    marks = sorted(int(n.split("=")[1]) for n in _complete(spark, path, "mark"))
    mark = spark.read.schema("mark timestamp").parquet(f"{path}/mark={marks[-1]}").first()[0] if marks else None
    rows = spark.read.schema(REQUEST).parquet(*[f"{path}/flags={n}" for n in range(marks[-1] + 1)]) if marks else spark.createDataFrame([], REQUEST)
    end = (F.col("window_no") + 1) * quota.seconds
    # A watermark has whole milliseconds.
    rows = rows.where(end * 1000 <= F.unix_millis(F.lit(mark)) - 1000 * delay_s) if mark else rows.limit(0)
    return rows.select(F.lit(quota.name).alias("quota"), "event_id", "request_key", "scope", (F.col("window_no") * quota.seconds).alias("window_start_s"))


def donation_stream(payments: DataFrame) -> DataFrame:
    """Running total of positive cents; the state is one number."""
    cents = payments.select(X.amount_to_cents(F.col("amount")).alias("cents")).filter("cents > 0")
    return cents.groupBy().agg(F.sum("cents").alias("total_cents"))


def quota_counts(requests: DataFrame, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Requests per key and fixed window, final once the watermark has passed the window; later rows are dropped."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("key", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests")).select(
        "key", F.unix_seconds("w.start").alias("window_start_s"), "requests"
    )


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into an append-only parquet table, exactly once across restarts."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_to_memory(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Process everything available into an in-memory table; only for results of fixed, small size."""
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("complete")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
