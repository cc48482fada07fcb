"""Prefix trie of conversations by time-forward processing.

1. Rows are numbered in slices of a range partition, so no task holds a whole conversation; conversations are rebuilt
   from the first turns of a base conversation and their own. The id of a prefix is the XOR of two 64-bit hashes of
   (position, role, text) over its turns, again summed along slices. Rows that agree on it form a node.
2. Nodes are cut into bands of levels that double in height; the nodes of a band under one node of its first level are
   a shard. A shard of more than ``SHARD`` nodes is cut at half its height, and so on to single levels, which are plain
   sums by parent. No shard is too large for a task, however many conversations share a prefix and however long one is.
3. Bands are processed from the deepest up. Spark sorts the nodes of a shard in reverse level order (an external sort);
   a task walks them once. A node takes its children's totals from the front of a priority queue and sends its own
   forward to its parent, which comes later in that order. Of the queue only ``HELD`` messages are in memory; others
   are spilled to sorted runs. Totals of shard roots are summed by parent and wait there for the next band.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import Scratch, spread_join

#: Turns taken from the base conversation are fewer than this; conversations that share a base.
TURNS, BASE = 6, 100
#: Height of the first band below the root, nodes of a shard, messages of a queue in memory, ids in one piece of a digest.
BAND, SHARD, HELD, PIECE = 32, 200_000, 100_000, 1000


class SpillingQueue:
    """Least key first; ``HELD`` messages in memory, further ones in sorted runs of temporary files of the task.

    A run is written when memory is full and read back through a small buffer, so memory stays bounded whatever waits.
    The files lie where Spark puts a task's own spills and have no name, so they go with the task.
    """

    def __init__(self, held: int):
        self.held, self.heap, self.runs, self.n = held, [], [], 0

    def push(self, key: tuple, value: tuple) -> None:
        heapq.heappush(self.heap, (key, self.n, value))
        self.n += 1
        if len(self.heap) > self.held:
            self.heap.sort()
            keep = self.held // 4
            run = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            for at in range(keep, len(self.heap), 512):
                pickle.dump(self.heap[at:at + 512], run, protocol=5)
            run.seek(0)
            self.heap = self.heap[:keep]
            self.runs.append(self._next((run, [], 0)))

    @staticmethod
    def _next(run: tuple) -> tuple | None:
        """The run with its next chunk, or None at its end."""
        try:
            return run[0], pickle.load(run[0]), 0
        except EOFError:
            run[0].close()
            return None

    def _first(self) -> int | None:
        """Index of the run whose first message is less than the heap's; -1 for the heap, None if all is empty."""
        best, at = (self.heap[0] if self.heap else None), (-1 if self.heap else None)
        for i, (_, chunk, k) in enumerate(self.runs):
            if best is None or chunk[k] < best:
                best, at = chunk[k], i
        return at

    def pop(self, key: tuple) -> Iterator[tuple]:
        """All messages of that key, which must be the least."""
        while (at := self._first()) is not None:
            if at < 0:
                if self.heap[0][0] != key:
                    return
                yield heapq.heappop(self.heap)[2]
                continue
            file, chunk, k = self.runs[at]
            if chunk[k][0] != key:
                return
            step = (file, chunk, k + 1) if k + 1 < len(chunk) else self._next((file, chunk, k))
            if step is None:
                del self.runs[at]
            else:
                self.runs[at] = step
            yield chunk[k][2]


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id -> the same with n, ra, rb: how many rows of its conversation the slice has had so far, and
    the XOR of a and b over them."""
    conv, n, a, b = None, 0, np.int64(0), np.int64(0)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, xa, xb = (batch.column(batch.schema.get_field_index(c)).to_numpy().copy() for c in ("conv_id", "a", "b"))
        first = np.concatenate([[conv is None or ids[0] != conv], ids[1:] != ids[:-1]])
        goes_on = not first[0]
        if goes_on:
            xa[0] ^= a
            xb[0] ^= b
            first[0] = True
        begin = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        ra, rb = np.bitwise_xor.accumulate(xa), np.bitwise_xor.accumulate(xb)
        # What the conversations before a row's own have added is taken out again.
        ra, rb = (r ^ np.where(begin > 0, r[begin - 1], 0)[group] for r in (ra, rb))
        count = np.arange(len(ids)) - begin[group] + 1
        if goes_on:
            count[group == 0] += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count), pa.array(ra), pa.array(rb)], [*batch.schema.names, "n", "ra", "rb"])
        conv, n, a, b = ids[-1], int(count[-1]), ra[-1], rb[-1]


def running(rows: DataFrame, order: list[str], ranges: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``rows(conv_id, a, b, ...)`` with n, ra, rb: position in the conversation under ``order``, and XORs up to the row.

    Rows are dealt by ``ranges``, which must not contradict (conv_id, order); the columns of ``order`` are then dropped.
    What a slice must know of earlier ones is one row per conversation that is cut: fewer than two per slice.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, *ranges).sortWithinPartitions("conv_id", *order).drop(*order)
    cut = cut.withColumn("slice", F.spark_partition_id().cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", n long, ra long, rb long"
    inside = scratch.put(cut.mapInArrow(_along, schema), name)
    tails = inside.groupBy("conv_id", "slice").agg(F.max("n").alias("n"), F.max_by("ra", "n").alias("ta"), F.max_by("rb", "n").alias("tb"))
    split = tails.groupBy("conv_id").agg(F.count("*").alias("slices")).where("slices > 1").select("conv_id")
    ends: dict[int, list[tuple]] = {}
    for r in tails.join(split, "conv_id").collect():
        ends.setdefault(r["conv_id"], []).append((r["slice"], r["n"], r["ta"], r["tb"]))
    carried = []
    for conv, tail in ends.items():
        n, a, b = 0, 0, 0
        for s, k, x, y in sorted(tail):
            carried.append((s, conv, n, a, b))
            n, a, b = n + k, a ^ x, b ^ y
    carry = F.broadcast(spark.createDataFrame(carried, "slice long, conv_id long, n0 long, a0 long, b0 long"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = inside.join(carry, ["slice", "conv_id"], "left").withColumns(
        {"n": F.col("n") + zero("n0"), "ra": F.col("ra").bitwiseXOR(zero("a0")), "rb": F.col("rb").bitwiseXOR(zero("b0"))})
    return out.drop("slice", "n0", "a0", "b0")


def _id(a: Column, b: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


#: Rows of one conversation that meet one copy of what is known of it.
CHUNK = 10_000


def _chunk(position: Column) -> Column:
    return F.floor(position / CHUNK).cast("long")


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, convs): conv_id, d, a, b, len, total of every rebuilt turn; conv_id, total of every conversation."""
    base = F.col("conv_id") - F.col("conv_id") % BASE
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64("text", F.lit(1), "role"), "len": F.length("text").cast("long")})
    # A prefix of the text is enough to deal the rows, so long texts are not sampled.
    deal = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, 64)]
    own = scratch.put(running(turns, ["turn", "role", "text"], deal, scratch, "turns").select("conv_id", "n", "a", "b", "len"), "own")
    sizes = own.groupBy("conv_id").agg(F.max("n").alias("own"))
    based = sizes.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % TURNS, "base": base})
    heads = sizes.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = based.join(heads, "base", "left").withColumn("p", F.least("h", F.coalesce("of_base", F.lit(0)))) \
        .withColumn("total", F.col("p") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    convs = scratch.put(convs.select("conv_id", "base", "own", "h", "p", "total"), "convs")
    copies = convs.select("conv_id", "h", "p", "total", F.explode(F.sequence(F.lit(0), _chunk(F.col("own")))).alias("chunk"))
    rest = own.withColumn("chunk", _chunk(F.col("n"))).join(copies, ["conv_id", "chunk"]).where("n > h") \
        .select("conv_id", (F.col("n") - F.col("h") + F.col("p")).alias("d"), "a", "b", "len", "total")
    first = own.where((base == F.col("conv_id")) & (F.col("n") < TURNS)).select(F.col("conv_id").alias("base"), F.col("n").alias("d"), "a", "b", "len")
    taken = convs.where("p > 0").join(first, "base").where("d <= p").select("conv_id", "d", "a", "b", "len", "total")
    rows = rest.unionByName(taken).withColumns({"a": F.xxhash64("d", "a", "b"), "b": F.xxhash64("b", "d", "a")})
    return rows, convs


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, piece) sorted -> id, SHA-256 of the pieces joined by commas; of a node only the state of the digest is held."""
    node, state = None, None
    for batch in batches:
        done = []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(piece.encode())
            else:
                state.update(("," + piece).encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([v for _, v in done], pa.string())], ["id", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["id", "ends"])


def ends_of(ended: DataFrame) -> DataFrame:
    """id, ends for ``ended(id, conv_id)``. Ids are joined in pieces first; a digest is a chain, so the pieces of a node
    pass through one task, which holds none of them."""
    pieces = ended.groupBy("id", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return pieces.repartition("id").sortWithinPartitions("id", "piece").select("id", "ids").mapInArrow(_digests, "id binary, ends string")


NODE = "id binary, parent binary, depth long, n_children long, n_leaves long, saved long"


def _forward(held: int):
    """(shard, depth, id, parent, value, in_children, in_leaves, in_saved), by shard in reverse level order -> NODE."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, top, queue = None, 0, SpillingQueue(held)
        for batch in batches:
            out = []
            for of, depth, node, parent, value, children, leaves, saved, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != shard:
                    shard, queue = of, SpillingQueue(held)
                for more, wood in queue.pop((-depth, node)):
                    children, leaves, saved = children + 1, leaves + more, saved + wood
                leaves, saved = (leaves if children else 1), saved + value
                if depth > lo:
                    queue.push((1 - depth, parent), (leaves, saved))
                out.append((node, parent, depth, children, leaves, saved))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary()] * 2 + [pa.int64()] * 4, strict=True)], ["id", "parent", "depth", "n_children", "n_leaves", "saved"])

    return run


class Bands:
    """Totals of a stored table of nodes (id, parent, depth, conv_id, value), band by band from the deepest up."""

    def __init__(self, nodes: DataFrame, paths: DataFrame, scratch: Scratch, shard: int, held: int):
        self.nodes, self.paths, self.scratch, self.held, self.done, self.k = nodes, paths, scratch, held, [], 0
        # At most 20,000 shards are larger than that.
        self.shard = max(shard, nodes.count() // 20_000)

    def _put(self, df: DataFrame, name: str) -> DataFrame:
        self.k += 1
        return self.scratch.put(df, f"{name}_{self.k}")

    def _finished(self, totals: DataFrame, lo: int) -> DataFrame:
        """Keeps the totals and returns what the roots, at level ``lo``, send on, summed by parent."""
        totals = self._put(totals, "totals")
        self.done.append(totals)
        return totals.where((F.col("depth") == lo) & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(
            F.count("*").alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))

    def band(self, nodes: DataFrame, sent: DataFrame | None, lo: int, hi: int) -> DataFrame:
        """Totals of ``nodes``, which fill whole shards between levels ``lo`` and ``hi`` (exclusive); ``sent`` by the band below."""
        names = ("in_children", "in_leaves", "in_saved")
        met = nodes.join(sent, "id", "left") if sent is not None else nodes.withColumns(dict.fromkeys(names, F.lit(None).cast("long")))
        met = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
        if hi - lo == 1:
            leaves = F.when(F.col("in_children") == 0, 1).otherwise(F.col("in_leaves"))
            return self._finished(met.select("id", "parent", "depth", F.col("in_children").alias("n_children"), leaves.cast("long").alias("n_leaves"), (F.col("in_saved") + F.col("value")).alias("saved")), lo)
        tops = self.paths.where(F.col("d") == lo).select("conv_id", F.col("id").alias("shard"), F.explode(F.sequence(_chunk(F.lit(lo)), _chunk(F.least(F.col("total"), F.lit(hi))))).alias("chunk"))
        met = self._put(met.withColumn("chunk", _chunk(F.col("depth"))).join(tops, ["conv_id", "chunk"]).drop("chunk"), "met")
        large = self._put(met.groupBy("shard").count().where(F.col("count") > self.shard).select("shard"), "large")
        hot = large.limit(1).count() > 0
        small = met.join(F.broadcast(large), "shard", "left_anti") if hot else met
        rows = small.select("shard", "depth", "id", "parent", "value", *names, F.lit(lo).cast("long").alias("lo"))
        totals = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "id").mapInArrow(_forward(self.held), NODE)
        up = self._finished(totals, lo)
        if not hot:
            return up
        mid = (lo + hi) // 2
        rest = self._put(met.join(F.broadcast(large), "shard", "left_semi"), "rest")
        lower = rest.where(F.col("depth") >= mid)
        sums = [F.sum(c).alias(c) for c in names]
        below = self.band(lower.select(nodes.columns), lower.select("id", *names), mid, hi)
        upper = rest.where(F.col("depth") < mid)
        both = upper.select("id", *names).unionByName(below).groupBy("id").agg(*sums)
        above = self.band(upper.select(nodes.columns), both, lo, mid)
        return up.unionByName(above).groupBy("id").agg(*sums)

    def totals(self, deepest: int, height: int) -> DataFrame:
        """NODE of all nodes."""
        cuts = [0, 1]
        while cuts[-1] <= deepest:
            cuts.append(cuts[-1] + height)
            height *= 2
        sent = None
        for lo, hi in reversed(list(zip(cuts[:-1], cuts[1:], strict=True))):
            sent = self.band(self.nodes.where((F.col("depth") >= lo) & (F.col("depth") < hi)), sent, lo, hi)
        out = self.done[0]
        for part in self.done[1:]:
            out = out.unionByName(part)
        return out


def trie(conversations: DataFrame, band: int = BAND, shard: int = SHARD, held: int = HELD) -> DataFrame:
    """One row per node of the trie of ``conversations(conv_id, turn, role, text)``: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are in order of turn, null first, then role and text, so ties and repeated rows have a place each; a null role
    or text is empty. Rows with a null conv_id belong to no conversation. Other columns are ignored. An empty table has
    no nodes; otherwise the root is there, with all conversations as members.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    rows, convs = rebuilt(conversations, scratch)
    walked = running(rows, ["d"], [F.col("conv_id"), F.col("d")], scratch, "paths").withColumnRenamed("n", "d")
    paths = walked.select("conv_id", "d", "total", "len", _id(F.col("ra"), F.col("rb")).alias("id"), _id(F.col("ra").bitwiseXOR(F.col("a")), F.col("rb").bitwiseXOR(F.col("b"))).alias("parent"))
    paths = scratch.put(paths, "walked")
    root = _id(F.lit(0).cast("long"), F.lit(0).cast("long"))
    summary = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")]
    nodes = paths.groupBy("id").agg(F.max("parent").alias("parent"), F.max("d").alias("depth"), *summary, F.max("len").alias("len"))
    top = convs.agg(*summary).where("n_convs > 0").select(root.alias("id"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("len"))
    nodes = scratch.put(nodes.unionByName(top).withColumn("value", (F.col("n_convs") - 1) * F.col("len")), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = Bands(nodes.select("id", "parent", "depth", "conv_id", "value"), paths, scratch, shard, held).totals(deepest, band)
    ended = paths.where("d = total").select("id", "conv_id").unionByName(convs.where("total = 0").select(root.alias("id"), "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    whole = nodes.join(totals.select("id", "n_children", "n_leaves", "saved"), "id").join(ends_of(ended), "id", "left")
    whole = scratch.put(whole.select("id", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256")), "whole")
    parents = scratch.put(whole.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"), "parents")
    out = spread_join(whole, parents, "parent", "n_children", F.col("id"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The same in DuckDB by another way: paths are lists of turns, and subtree sums are suffix sums along the conversations.
SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c::VARCHAR AS name FROM turns),
crc AS (
  SELECT c, name, 0 AS k, 8 AS bit, 4294967295::BIGINT AS z FROM ids
  UNION ALL
  SELECT c, name, CASE WHEN bit = 8 THEN k + 1 ELSE k END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END,
         CASE WHEN bit = 8 THEN xor(z, ascii(substr(name, k + 1, 1))::BIGINT) WHEN z % 2 = 1 THEN xor(z // 2, 3988292384) ELSE z // 2 END
  FROM crc WHERE NOT (bit = 8 AND k = length(name))),
sizes AS (
  SELECT c, (SELECT max(n) FROM turns WHERE turns.c = crc.c) AS own, xor(z, 4294967295) % 6 AS h, c - c % 100 AS base
  FROM crc WHERE bit = 8 AND k = length(name)),
rebuilt AS (
  SELECT t.c, t.n - s.h + least(s.h, coalesce(b.own, 0)) AS d, t.x
  FROM turns t JOIN sizes s ON t.c = s.c LEFT JOIN sizes b ON b.c = s.base WHERE t.n > s.h
  UNION ALL
  SELECT s.c, t.n, t.x FROM sizes s JOIN turns t ON t.c = s.base WHERE t.n <= s.h),
paths AS (
  SELECT c, d, list(x) OVER (PARTITION BY c ORDER BY d) AS path, x.text AS text FROM rebuilt
  UNION ALL SELECT c, 0, [], '' FROM sizes),
long AS (SELECT c, d, path, text, max(d) OVER (PARTITION BY c) AS total FROM paths),
nodes AS (
  SELECT path, min(d) AS d, min(c) AS m, count(*) AS n, max(length(text)) AS len, max(total) AS deepest,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = total), '')) AS ends
  FROM long GROUP BY path),
own AS (
  SELECT l.c, l.d, l.path, CASE WHEN l.c = n.m THEN (n.n - 1) * n.len ELSE 0 END AS saved, CASE WHEN l.c = n.m AND n.deepest = n.d THEN 1 ELSE 0 END AS leaf
  FROM long l JOIN nodes n ON l.path = n.path),
suffix AS (SELECT path, sum(saved) OVER w AS saved, sum(leaf) OVER w AS leaves FROM own WINDOW w AS (PARTITION BY c ORDER BY d DESC)),
totals AS (SELECT path, sum(saved) AS saved, sum(leaves) AS leaves FROM suffix GROUP BY path),
children AS (SELECT path[:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1)
SELECT n.m::BIGINT AS conv_id, n.d::BIGINT AS depth, p.m::BIGINT AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN totals t ON n.path = t.path LEFT JOIN children k ON k.path = n.path
LEFT JOIN nodes p ON n.d > 0 AND p.path = n.path[:n.d - 1]
"""
