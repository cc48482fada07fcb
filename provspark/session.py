"""Session settings shared by jobs, tests and benchmarks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession

# Settings every job relies on; all are runtime-settable, so they also apply to a session handed in from outside.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.caseSensitive": "true",
    # Splitting one JSON parse into a pruned parse per field costs more than it saves here.
    "spark.sql.optimizer.enableJsonExpressionOptimization": "false",
}

# Shuffles go when the command that made them has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """A session over the same context with the runtime settings; the caller's own session keeps its settings."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in RUNTIME_CONF.items():
        own.conf.set(key, value)
    return own


def local_session(app: str = "provspark", cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder that the cluster names in ``spark.checkpoint.dir``; without it, an error.

    Only a session of one JVM (``local``) may lack the setting, as in tests: a folder of its machine is shared by all its
    tasks. The path is deleted when the driver program ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _single_machine_folder()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


@lru_cache(maxsize=1)
def _single_machine_folder() -> str:
    return tempfile.mkdtemp(prefix="provspark-")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the context has stopped, and with it the way to the folder
        pass


def cut_lineage(spark: SparkSession, df, name: str):
    """Write ``df`` to the shared folder and read it back: a plan break that survives the loss of executors.

    The shuffles of the writing are deleted at its end, not when the driver happens to collect its garbage.
    """
    path = work_folder(spark, name)
    own = df.sparkSession
    before = own.conf.get(FREE_SHUFFLES, None)
    own.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        own.conf.unset(FREE_SHUFFLES) if before is None else own.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
