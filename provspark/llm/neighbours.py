"""Approximate nearest neighbours by cosine: a forest of random-projection trees, one queue for all trees of a query.

Trees are fitted on at most ``SAMPLE`` vectors, those of least hash of their id; every row is indexed. A node splits at
the median along the difference of two of its unit vectors. A query opens leaves of all trees from one queue, nearest
boundary first, until ``LEAVES`` are open. In a leaf all rows are scored exactly in double precision, so what is
approximate is only which rows are looked at.

Vectors of equal direction are one class that is looked at once; with its six least ids it serves every query without loss. Leaves
above ``CHUNK`` rows are cut into chunks, each of which meets the leaf's queries.

Vectors that are null, zero or hold null or non-finite components take no part; shorter ones count as padded with zeros.
A query's own id is never among its neighbours. Repeated ids with equal vectors count once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import Scratch

SAMPLE, TREES, LEAF, LEAVES, CHUNK = 20_000, 16, 128, 180, 4_000
NEAREST = 5


@dataclass(frozen=True)
class Tree:
    """Inner node i: normal, cut, children; a child below zero is leaf ``-child - 1``."""

    normals: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        at = np.full(len(unit), 0 if len(self.cuts) else -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            side = np.einsum("ij,ij->i", unit[inner], self.normals[node]) > self.cuts[node]
            at[inner] = np.where(side, self.high[node], self.low[node])
        return -at - 1


def grow(unit: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Tree:
    normals, cuts, low, high, leaves = [], [], [], [], 0
    todo = [(np.arange(len(unit)), None, None)]
    while todo:
        rows, parent, side = todo.pop()
        made = None
        if len(rows) > leaf:
            for _ in range(8):  # equal projections cannot be split; other points may
                a, b = rng.choice(rows, 2, replace=False)
                normal = unit[a] - unit[b]
                value = unit[rows] @ normal
                cut = float(np.median(value))
                above = value > cut
                if 0 < above.sum() < len(rows):
                    made = len(cuts)
                    normals.append(normal)
                    cuts.append(cut)
                    low.append(0)
                    high.append(0)
                    todo += [(rows[~above], made, low), (rows[above], made, high)]
                    break
        if made is None:
            leaves += 1
            made = -leaves
        if parent is not None:
            side[parent] = made
    return Tree(np.array(normals).reshape(len(cuts), unit.shape[1]), np.array(cuts), np.array(low, int), np.array(high, int))


def open_leaves(trees: list[Tree], unit: np.ndarray, leaves: int = LEAVES) -> list[tuple[int, int]]:
    """(tree, leaf) pairs of one unit vector, nearest boundary first."""
    queue = [(0.0, t, 0 if len(tree.cuts) else -1) for t, tree in enumerate(trees)]
    sides = [tree.normals @ unit - tree.cuts for tree in trees]
    out = []
    while queue and len(out) < leaves:
        far, t, node = heapq.heappop(queue)
        tree, side = trees[t], sides[t]
        while node >= 0:
            s = side[node]
            other, node = (tree.low[node], tree.high[node]) if s > 0 else (tree.high[node], tree.low[node])
            heapq.heappush(queue, (max(far, abs(float(s))), t, int(other)))
        out.append((t, int(-node - 1)))
    return out


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a column of equally long arrays; scaled first, so that no square overflows or vanishes."""
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    with np.errstate(all="ignore"):
        scaled = out / np.abs(out).max(1, keepdims=True)
        return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _unit_rows(width: int):
    """(id, v) -> the same with unit vectors; what differs by a power of two is equal from here on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _units(batch.column(1), width) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * width), pa.array(unit.ravel()))], ["id", "v"])

    return run


def _valid(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _route(forest, width: int, queries: bool):
    """(rep, tree, leaf): every class in each tree's leaf, or a query in the leaves that it opens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        for batch in batches:
            unit = _units(batch.column(1), width)
            if queries:
                opened = [open_leaves(trees, u) for u in unit]
                sizes = [len(o) for o in opened]
                t, leaf = np.array([x for o in opened for x in o], int).reshape(-1, 2).T
                row = np.repeat(np.arange(len(unit)), sizes)
            else:
                row = np.tile(np.arange(len(unit)), len(trees))
                t = np.repeat(np.arange(len(trees)), len(unit))
                leaf = np.concatenate([tree.leaves(unit) for tree in trees])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(t, pa.int32()), pa.array(leaf, pa.int32())], ["rep", "v", "tree", "leaf"])

    return run


def _scored(width: int, keep: int):
    """Rows (tile, query, rep, v) sorted by tile with queries first: each query's ``keep`` best rows in every
    batch of the tile, and those that tie with the last of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, names, asked = None, [], []
        for batch in batches:
            tiles, query, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            unit = _units(batch.column(3), width)
            cuts = np.flatnonzero((tiles[1:] != tiles[:-1]) | (query[1:] != query[:-1])) + 1
            out = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tiles)], strict=True):
                if hi == lo:
                    continue
                if tiles[lo] != tile:
                    tile, names, asked = tiles[lo], [], []
                if query[lo]:
                    names.append(rep[lo:hi])
                    asked.append(unit[lo:hi])
                elif names:
                    score = np.concatenate(asked) @ unit[lo:hi].T
                    n = min(keep, hi - lo)
                    row, top = np.nonzero(score >= np.partition(score, -n, axis=1)[:, -n:-n + 1 or None])
                    out.append((np.concatenate(names)[row], rep[lo:hi][top], score[row, top]))
            a, b, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["query", "rep", "score"])

    return run


def fit(classes: DataFrame, width: int, seed: int = 11) -> list[Tree]:
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()
    unit = _units(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), width)
    return [grow(unit, np.random.default_rng(seed + t)) for t in range(TREES)]


def nearest(vectors: DataFrame, every: int = 50, vec: str = "embedding", key: str = "vec_id", k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v")).where("id is not null and v is not null").where(_valid(F.col("v")))
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    zero = F.lit(0).cast(rows.schema["v"].dataType.elementType)
    padded = F.when(F.size("v") < width, F.concat("v", F.array_repeat(zero, F.lit(width) - F.size("v")))).otherwise(F.col("v"))
    unit = rows.select("id", padded.alias("v")).mapInArrow(_unit_rows(width), "id long, v array<double>")
    rows = scratch.put(unit.withColumn("same", F.xxhash64("v")), "rows")
    # Spark keeps row_number() <= n per task before it shuffles, so a class of any size sends few rows.
    number = F.row_number().over(Window.partitionBy("same", "v").orderBy("id"))
    least = rows.dropDuplicates(["id", "same", "v"]).withColumn("n", number).where(F.col("n") <= k + 1)
    classes = scratch.put(least.groupBy("same", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "classes")
    ids = classes.select("rep", F.explode("ids").alias("vec_id"))
    asked = rows.where(F.col("id") % every == 0).select("id", "same", "v").distinct()
    asked = scratch.put(asked.join(classes.select("same", "v", "rep"), ["same", "v"]).select(F.col("id").alias("query_id"), "rep"), "asked")
    forest = spark.sparkContext.broadcast(fit(classes, width))  # at most SAMPLE / LEAF nodes a tree
    schema = "rep long, v array<double>, tree int, leaf int"
    placed = scratch.put(classes.select("rep", "v").mapInArrow(_route(forest, width, False), schema), "placed")
    open_ = classes.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v").mapInArrow(_route(forest, width, True), schema)
    chunks = F.broadcast(placed.groupBy("tree", "leaf").agg((F.count("*") / CHUNK).cast("int").alias("more")))  # a row for each leaf
    salted = placed.join(chunks, ["tree", "leaf"]).select(F.xxhash64("tree", "leaf", F.pmod(F.xxhash64("rep"), F.col("more") + 1)).alias("tile"), F.lit(False).alias("query"), "rep", "v")
    wanted = open_.join(chunks, ["tree", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more").cast("long")))) \
        .select(F.xxhash64("tree", "leaf", "part").alias("tile"), F.lit(True).alias("query"), "rep", "v")
    tiles = salted.unionByName(wanted).repartition("tile").sortWithinPartitions("tile", F.desc("query"))
    found = tiles.mapInArrow(_scored(width, k + 1), "query long, rep long, score double").groupBy("query", "rep").agg(F.max("score").alias("score"))
    # The query's own class may be one of them; ties with the last one all stay until ids decide.
    found = found.withColumn("n", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("n") <= k + 1).drop("n")
    pairs = asked.join(found.withColumnRenamed("rep", "found"), F.col("rep") == F.col("query")).select("query_id", F.col("found").alias("rep"), "score")
    ranked = pairs.join(ids, "rep").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
