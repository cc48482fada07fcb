"""Small helpers shared by the operators: tables, the shared folder, spans found with JVM functions, word bytes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; all other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits of the bitmap that rows are held against before a join with few of them.
ROW_BITS = 1 << 24


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _single_machine_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one, for a single-JVM session only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _single_machine_folder()
    raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


class Scratch:
    """Tables of one run in the shared folder. ``put`` writes and rereads, which cuts the lineage and survives lost
    executors; ``drop`` deletes what no later step reads; the rest goes when the driver program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str | None = None) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone, and with it the way to the folder
            pass


def spans_of(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of a Java pattern as array<struct<start,end,body>>, in code points.

    The pieces between the matches and the matches themselves alternate, so running sums of lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), body.alias("body"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,body:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        end = at + F.length(x["hit"])
        one = F.array(F.struct(at.cast("long").alias("start"), end.cast("long").alias("end"), x["body"].alias("body")))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.cast("long").alias("at"), F.concat(acc["out"], one).alias("out")))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def span_text(kinds: list[tuple[str, Column]]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined; the columns are arrays of structs with start, end."""
    def tag(i: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), F.lit(kind).alias("name")))

    tagged = [tag(i, k, c) for i, (k, c) in enumerate(kinds)]
    every = F.array_sort(reduce(lambda a, b: F.concat(a, b), tagged))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


class WordHash(dict):
    """64-bit hashes of word bytes; kept for frequent words, forgotten when too many have been seen."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def in_chunks(batch, text: str, limit: int = 2_000_000):
    """Slices (from, to, texts) of an Arrow batch with about ``limit`` characters each; null texts are None."""
    column = batch.column(batch.schema.get_field_index(text))
    start, size, texts = 0, 0, []
    for i in range(batch.num_rows):
        t = column[i].as_py()
        texts.append(t)
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1, texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield start, batch.num_rows, texts


def apart(rows: DataFrame, known: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(other, maybe): rows whose ``names`` are in no row of ``known``, by a bitmap of fixed size, and the rest.

    Words of the bitmap are broadcast (at most ``ROW_BITS / 64`` rows), so whole rows are not shuffled; the rest, all rows
    of ``known`` and some by chance, is for an exact join. Nulls count as values.
    """
    place = F.xxhash64(*names).bitwiseAND(ROW_BITS - 1)
    one = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    words = known.select(place.alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(one).alias("_bits"))
    told = rows.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(words), "_word", "left")
    told = told.withColumn("_maybe", F.coalesce("_bits", F.lit(0).cast("long")).bitwiseAND(one) != 0)
    return tuple(told.where(which).select(*[F.col(c) for c in rows.columns]) for which in (~F.col("_maybe"), F.col("_maybe")))


def among(rows: DataFrame, known: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``names`` are in no row of ``known``, the others); only what ``apart`` lets through is shuffled."""
    other, maybe = apart(rows, known, names)
    keys = known.select(*[F.col(c).alias(f"_known_{i}") for i, c in enumerate(names)]).distinct()
    same = reduce(lambda a, b: a & b, [maybe[c].eqNullSafe(F.col(f"_known_{i}")) for i, c in enumerate(names)])
    return other.unionByName(maybe.join(keys, same, "left_anti")), maybe.join(keys, same, "left_semi")


def spread_join(many: DataFrame, one: DataFrame, key: str, rows: str, spread: Column, parts: int = 64, share: int = 1000) -> DataFrame:
    """``many`` left-joined with ``one`` (a stored table, one row per ``key``) without a task that holds a hot key.

    ``one[rows]`` is the number of rows of ``many`` with the key. Keys with more than a ``share``-th of all rows, of
    which there are fewer than ``share`` whatever the input, are broadcast and dealt over ``parts`` by ``spread``.
    """
    total = one.agg(F.sum(rows)).first()[0] or 0
    hot = F.broadcast(one.where(F.col(rows) > total / share).select(key, F.lit(True).alias("_hot")))
    salted = many.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(0).cast("int")).drop("_hot")
    last = F.when(F.col("_hot"), parts - 1).otherwise(0)
    copies = one.drop(rows).join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")
