"""The stored relations: explicit schemas, reading, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_LONG, _TEXT, _TIME, _DOUBLE = T.LongType(), T.StringType(), T.TimestampType(), T.DoubleType()

SCHEMAS: dict[str, T.StructType] = {
    "image_registry": _schema(("image_id", _LONG), ("phash", _TEXT), ("whash", _TEXT), ("created_at", _TIME)),
    "vote_event": _schema(("event_id", _LONG), ("ts", _TIME), ("image_id", _LONG), ("voter_id", _TEXT), ("choice", _TEXT)),
    "report_event": _schema(
        ("event_id", _LONG), ("ts", _TIME), ("image_id", _LONG), ("voter_id", _TEXT), ("provider", _TEXT),
        ("detector", _TEXT), ("result", _TEXT)),
    "provenance_fact": _schema(("image_id", _LONG), ("analyzer", _TEXT), ("data", _TEXT)),
    "image_source": _schema(("image_id", _LONG), ("url", _TEXT)),
    "image_containment": _schema(
        ("link_id", _LONG), ("parent_id", _LONG), ("child_id", _LONG), ("crop_box", T.ArrayType(_DOUBLE))),
    "image_local_features": _schema(
        ("image_id", _LONG), ("kp_idx", _LONG), ("d0", _LONG), ("d1", _LONG), ("d2", _LONG), ("d3", _LONG),
        ("x", _DOUBLE), ("y", _DOUBLE)),
    "image_consensus": _schema(("image_id", _LONG), ("vote_real", _LONG), ("vote_edited", _LONG), ("vote_ai", _LONG)),
    "payment_event": _schema(("payment_id", _LONG), ("amount", _TEXT)),
}


def write_relation(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Write one relation in its fixed schema."""
    schema = SCHEMAS[name]
    df.select(*[df[f.name].cast(f.dataType) for f in schema.fields]).write.mode(mode).parquet(f"{root}/{name}")


def load_relation(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one relation with its fixed schema; nothing is inferred and only the columns used are read."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: load_relation(spark, root, name) for name in SCHEMAS}
