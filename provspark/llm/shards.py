"""Balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

Documents with equal texts are linked. Members of a group on the same shard are interchangeable, so what moves is a
cell (group, shard, count); a group of any size is 16 cells at most and no link is ever listed. Unlinked documents have
no neighbours and give way, so a shard's quota is its even share less the linked rows on it. Groups above a
``1 / LARGE`` of a shard, of which there are ``shards * LARGE`` at most, are placed one by one on the driver, the largest first. A
round for the others is three aggregations: neighbours' shards per group, wishes per (target shard, bucket, own shard),
loads per shard. The last two have a fixed number of rows and meet on the driver, which grants each wish as far as the
quotas of the shards allow. A last exact step levels the counts, unlinked documents first, and numbers the slots by
counting sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import Scratch

SHARDS = 16
ROUNDS = 4
#: Buckets of wishes in a round, and of the counting sort of slots.
WISHES, BUCKETS = 256, 1024
#: A group of more than this part of a shard is placed by itself.
LARGE = 256


def _table(values: dict, *keys: Column, default) -> Column:
    """Lookup of a fixed, small table by keys."""
    if not values:
        return F.lit(default)
    rows = F.create_map(*[x for k, v in values.items() for x in (F.lit(":".join(map(str, k))), F.lit(v))])
    return F.coalesce(F.try_element_at(rows, F.concat_ws(":", *[k.cast("string") for k in keys])), F.lit(default))


def _dense(rows: DataFrame, part: Column, order: list[Column], name: str) -> DataFrame:
    """Gapless numbers from 0 inside each part by (bucket, order): buckets counted first, then numbered one by one."""
    bucketed = rows.withColumn("_part", part).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS)).cast("int") + F.when(F.col("linked"), BUCKETS).otherwise(0))
    counts = bucketed.groupBy("_part", "_bucket").count().orderBy("_part", "_bucket").collect()  # parts x 2 x BUCKETS rows at most
    before, at, last = [], 0, None
    for r in counts:
        at = 0 if r["_part"] != last else at
        before.append((r["_part"], r["_bucket"], at))
        at, last = at + r["count"], r["_part"]
    offsets = rows.sparkSession.createDataFrame(before, "_part int, _bucket int, _before long")
    within = F.row_number().over(Window.partitionBy("_part", "_bucket").orderBy(*order))
    return bucketed.join(F.broadcast(offsets), ["_part", "_bucket"]).withColumn(name, F.col("_before") + within - 1).drop("_part", "_bucket", "_before")


def _placed(groups: dict[bytes, dict[int, int]], room: list[int]) -> list[tuple[bytes, int, int]]:
    """(group, shard, count) of large groups given their rows per shard; takes from ``room``. A group goes whole to the
    shard with most of it among those that can hold it; one that no shard can hold fills the emptiest shards first."""
    out = []
    for grp, cells in sorted(groups.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        left = sum(cells.values())
        while left:
            fits = [s for s, r in enumerate(room) if r >= left]
            s = max(fits, key=lambda s: (cells.get(s, 0), room[s])) if fits else max(range(len(room)), key=lambda s: (room[s], cells.get(s, 0)))
            n = min(left, room[s])
            out.append((grp, s, n))
            room[s] -= n
            left -= n
    return out


def _granted(asked: dict[tuple[int, int], dict[int, int]], load: list[int], quota: list[int]) -> dict[tuple[int, int, int], int]:
    """Rows that may move by (target, bucket, source), of those asked for by (target, bucket) and source.

    All wishes count as granted at first, so that shards can exchange rows whatever room they have; then shards above
    their quota give rows back, to sources with most room first, until none is above it by what it was granted.
    ``load`` becomes the load after the moves.
    """
    size = len(load)
    stacks: dict[tuple[int, int], list] = {}
    for (target, bucket), sources in sorted(asked.items()):
        for source, n in sources.items():
            stacks.setdefault((target, source), []).append([bucket, n])
            load[target] += n
            load[source] -= n
    while True:
        over = [t for t in range(size) if load[t] > quota[t] and any((t, s) in stacks for s in range(size))]
        if not over:
            break
        t = max(over, key=lambda t: load[t] - quota[t])
        s = min((s for s in range(size) if (t, s) in stacks), key=lambda s: load[s] - quota[s])
        last, excess, room = stacks[t, s][-1], load[t] - quota[t], quota[s] - load[s]
        n = min(last[1], excess, room if room > 0 else excess)
        last[1] -= n
        load[t] -= n
        load[s] += n
        if not last[1]:
            stacks[t, s].pop()
            if not stacks[t, s]:
                del stacks[t, s]
    return {(target, bucket, source): n for (target, source), wishes in stacks.items() for bucket, n in wishes}


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs(doc_id, text)``; law ``rows``.

    Shards' row counts differ by one at most. Equal texts lie on one shard as far as capacity allows: a group larger
    than a shard is spread over as few as the quotas give. A null text counts as the empty one (size 1, crc32 0), all
    of these are one group. Repeated rows and null ids are rows like others. No rows: an empty result. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    # Ids may repeat or be null: a row's place among equal rows does not matter, they are interchangeable.
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("grp"))
    base = scratch.put(base, "base")
    total = base.count()
    groups = scratch.put(base.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    # Every row starts where its id hashes to; the rows of groups are counted into cells, which then move.
    home = F.pmod(F.xxhash64("grp", F.lit(1)), F.lit(shards)).cast("int")
    start = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(shards)).cast("int")
    cells = base.join(groups.select("grp"), "grp").groupBy("grp", start.alias("shard")).agg(F.count("*").alias("n"))
    every = scratch.put(cells, "cells")
    large = F.broadcast(groups.where(F.col("n") * LARGE * shards > total).select("grp"))  # fewer than shards x LARGE rows
    found: dict[bytes, dict[int, int]] = {}
    for r in every.join(large, "grp").collect():
        found.setdefault(bytes(r["grp"]), {})[r["shard"]] = r["n"]
    quota = _even(total, shards)
    placed = spark.createDataFrame(_placed(found, quota), "grp binary, shard int, n long")  # the quotas shrink by what is placed
    cells = every.join(large, "grp", "left_anti")
    for k in range(1, rounds + 1):
        load = [0] * shards
        for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            load[r["shard"]] += r["n"]
        if k == 1:  # afterwards shards are full that had to give back
            full = [s for s in range(shards) if load[s] > 2 * quota[s]]
        # The shard with most neighbours, among equals the home of the group's hash. Scattered groups pass by full
        # shards; those that lie on full shards alone go to another, and so do whole ones as far as their shard is above its quota.
        above = F.array(*[F.lit(max(0.0, 1 - quota[s] / load[s]) if load[s] else 0.0) for s in range(shards)])
        free = [s for s in range(shards) if s not in full] or list(range(shards))
        other = F.get(F.array(*map(F.lit, free)), F.pmod(F.xxhash64("grp", F.lit(1)), F.lit(len(free))).cast("int"))
        best = cells.groupBy("grp").agg(F.max(F.struct(F.col("shard").isin(free).alias("free"), "n", F.pmod(F.col("shard") - home, F.lit(shards)).alias("d"))).alias("b"), F.count("*").alias("cells")) \
            .withColumn("at", F.pmod(F.col("b.d") + home, F.lit(shards)).cast("int"))
        leaves = (F.col("cells") > 1) | (F.pmod(F.xxhash64("grp", F.lit(-k)), F.lit(1 << 20)) < F.get(above, "at") * (1 << 20))
        best = best.select("grp", F.when(~F.col("b.free") & leaves, other).otherwise(F.col("at")).cast("int").alias("target"))
        wish = cells.join(best, "grp").withColumn("bucket", F.pmod(F.xxhash64("grp", F.lit(k)), F.lit(WISHES)).cast("int"))
        asked: dict[tuple[int, int], dict[int, int]] = {}
        for r in wish.where("shard <> target").groupBy("target", "bucket", "shard").agg(F.sum("n").alias("n")).collect():
            asked.setdefault((r["target"], r["bucket"]), {})[r["shard"]] = r["n"]
        granted = _granted(asked, load, quota)
        if not granted:
            break
        full = [s for s in range(shards) if load[s] >= quota[s]]
        # shards x WISHES x shards rows at most; of a wish granted in part, the first groups in one order move.
        grants = F.broadcast(spark.createDataFrame([(*key, n, n == asked[key[:2]][key[2]]) for key, n in sorted(granted.items())], "target int, bucket int, shard int, go long, whole boolean"))
        wish = wish.join(grants, ["target", "bucket", "shard"], "left")
        before = F.sum("n").over(Window.partitionBy("target", "bucket", "shard").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))
        some = wish.where("not whole").withColumn("go", F.greatest(F.lit(0), F.least(F.col("n"), F.col("go") - F.coalesce(before, F.lit(0)))))
        rest = wish.where("whole is null or whole").withColumn("go", F.when(F.col("whole"), F.col("n")).otherwise(0))
        parts = F.explode(F.array(F.struct(F.col("target").alias("shard"), F.col("go").alias("n")), F.struct("shard", (F.col("n") - F.col("go")).alias("n"))))
        moved = rest.select("grp", "shard", "target", "n", "go").unionByName(some.select("grp", "shard", "target", "n", "go")).select("grp", parts.alias("p")).select("grp", "p.shard", "p.n").where("n > 0")
        cells = scratch.put(moved.groupBy("grp", "shard").agg(F.sum("n").alias("n")), f"cells{k}")
        if k > 1:
            scratch.drop(f"cells{k - 1}")
    return _level(base, groups, cells.select("grp", "shard", "n").unionByName(placed), total, shards, start, scratch)


def _even(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _level(base: DataFrame, groups: DataFrame, cells: DataFrame, total: int, shards: int, start: Column, scratch: Scratch) -> DataFrame:
    """Rows take their group's cells in order, then rows above the even count go to shards below it."""
    spark = base.sparkSession
    # One row per group with the running ends of its cells; a row's number in the group picks the cell.
    ends = cells.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("cells"))
    numbered = _in_group(base.join(groups.select("grp"), "grp"), scratch)
    walk = F.aggregate("cells", F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("int").alias("s")),
                       lambda a, c: F.struct((a["at"] + c["n"]).alias("at"), F.when(a["s"].isNull() & (F.col("rank") < a["at"] + c["n"]), c["shard"]).otherwise(a["s"]).alias("s")),
                       lambda a: a["s"])
    linked = numbered.join(ends, "grp").select("doc_id", "size", "text_crc32", walk.alias("shard"), F.lit(True).alias("linked"))
    single = base.join(groups, "grp", "left_anti").select("doc_id", "size", "text_crc32", start.alias("shard"), F.lit(False).alias("linked"))
    rows = scratch.put(linked.unionByName(single), "rows")
    ranked = _dense(rows, F.col("shard"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "rank")
    load = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    even = _even(total, shards)
    over = {s: max(0, load.get(s, 0) - even[s]) for s in range(shards)}
    ahead, at = {}, 0
    for s in range(shards):
        ahead[s] = at
        at += over[s]
    # The i-th row in excess takes the i-th free place.
    place, free = F.lit(None).cast("int"), 0
    bounds = []
    for s in range(shards):
        free += max(0, even[s] - load.get(s, 0))
        bounds.append((free, s))
    index = _table({(s,): v for s, v in ahead.items()}, F.col("shard"), default=0).cast("long") + F.col("rank")
    for end, s in reversed(bounds):
        place = F.when(index < end, F.lit(s)).otherwise(place)
    excess = F.col("rank") < _table({(s,): v for s, v in over.items()}, F.col("shard"), default=0)
    final = scratch.put(ranked.withColumn("shard", F.when(excess, place).otherwise(F.col("shard"))).drop("rank"), "final")
    slots = _dense(final, F.col("shard"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")


def _in_group(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Number of each row inside its group from 0; a group of any size is numbered in 256 parts."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(256)).cast("int")
    parts = rows.withColumn("part", part)
    counts = parts.groupBy("grp", "part").agg(F.count("*").alias("n"))
    before = counts.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))  # 256 entries at most
    start = F.aggregate(F.filter("parts", lambda p: p["part"] < F.col("part")), F.lit(0).cast("long"), lambda a, p: a + p["n"])
    within = F.row_number().over(Window.partitionBy("grp", "part").orderBy("doc_id"))
    return parts.withColumn("within", within).join(before, "grp").withColumn("rank", start + F.col("within") - 1).drop("within", "part", "parts")
