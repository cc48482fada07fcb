"""Image payloads: reading files as bytes and telling their format from the first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading bytes (hex) per media type and the AVIF brands of an ISO base media file.
MAGIC = (
    ("FFD8FF", "image/jpeg"),
    ("89504E470D0A1A0A", "image/png"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
)
AVIF_BRANDS = ("avif", "avis", "av01", "mif1", "msf1")
UNKNOWN = "application/octet-stream"


def media_type(content: Column) -> Column:
    """Media type by leading bytes; unknown content is an octet stream. Reads twelve bytes, not the payload."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith(MAGIC[0][0]), MAGIC[0][1])
    for prefix, mime in MAGIC[1:]:
        out = out.when(head.startswith(prefix), mime)
    brands = [b.encode().hex().upper() for b in AVIF_BRANDS]
    riff_webp = head.startswith(b"RIFF".hex().upper()) & (F.substring(head, 17, 8) == b"WEBP".hex().upper())
    avif = (F.substring(head, 9, 8) == b"ftyp".hex().upper()) & F.substring(head, 17, 8).isin(brands)
    return out.when(riff_webp, "image/webp").when(avif, "image/avif").otherwise(UNKNOWN)


def read_payloads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under ``path`` as ``(path, length, media_type, content)``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", media_type(F.col("content")).alias("media_type"), "content")
