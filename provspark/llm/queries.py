"""The registered queries of the operators, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm import align, html, jaccard, leaks, minhash, mixing, neighbours, pieces, pii, quality, secrets, shards, trie
from provspark.llm.common import read, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op10_balanced_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_secret_ledger", secrets.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets_of(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op8_spaced_seed_leaks")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op3_shingle_jaccard")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


@query("op9_boosted_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op2_bradley_terry")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", (remainder(F.col("doc_id"), quality.FOLDS) == 0).alias("held_out"), "score", "predicted")


@query("op6_projection_forest")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


@query("op1_block_labeller")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(read(spark, sf_dir, "pages"))


@query("op5_context_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scored(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_gumbel_pieces")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sampled_and_decoded(read(spark, sf_dir, "documents").select("doc_id", "text"), pieces.model_bytes(), out="gives_text_back")


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(read(spark, sf_dir, "documents").select("doc_id", "text"))[0]


@query("op11_prefix_trie", trie.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(read(spark, sf_dir, "conversations"))


@query("op13_bottom_k")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))
