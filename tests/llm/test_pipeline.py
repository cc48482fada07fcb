"""The pipeline's stages against plain versions, each on what its predecessor kept."""

import re

import corpus_pipeline as C
import plain
from pyspark.sql import functions as F

from provspark.llm import pieces
from provspark.llm.common import Scratch


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark, "test")
    kept = []
    for name, stage in C.STAGES:
        docs = scratch.put(stage(spark, docs, small), name)
        if name != "pieces":
            assert docs.columns == columns
        kept.append(docs)
    quality, single, clean, safe, coded = kept
    labels = dict(spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality").collect())
    left = {d for d, _ in rows_of(quality)}
    judged = [(d in left) == (q == 1) for d, q in labels.items()]
    assert sum(judged) >= 0.9 * len(judged)
    before = rows_of(quality)
    first = [d for (d, _), (_, c) in zip(before, plain.near_duplicates(before)) if d == c]
    assert sorted(d for d, _ in rows_of(single)) == sorted(first)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    found = {d for d, _ in plain.leaks([(d, t) for d, t in rows_of(single) if len(t or "") < 1500], items)}
    remaining = {d for d, _ in rows_of(clean)}
    assert not found & remaining and {d for d, t in rows_of(single) if len(t or "") < 1500} - found <= remaining
    text = dict(rows_of(clean))
    for d, t in rows_of(safe):
        counts, _, spans = plain.spans(text[d], plain.PERSONAL)
        assert (t == text[d]) == (not sum(counts) and not re.search(r"\[(SPELLED|LOCAL|NUMBER|NATIONAL|COLONS)\]", t or ""))
        assert not sum(plain.spans(t, plain.PERSONAL)[0])
    assert safe.where(F.col("n_chars") != F.length("text")).count() == 0
    back = pieces.decoded(coded, pieces.model_bytes()).collect()
    assert {(r.doc_id, r.text) for r in back} == {(d, t or "") for d, t in rows_of(safe)}
    assert C.run(spark, small).count() == coded.count()
