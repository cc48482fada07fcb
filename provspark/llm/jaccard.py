"""Similarity join on 5-word shingle sets (Jaccard of 0.8 or more), exact, with components.

1. Every text becomes its sorted set of 64-bit shingle hashes; texts with equal sets are one set from here on.
2. In hash order, the first ``n - ceil(0.8 n) + l`` shingles of two linked sets share at least ``l``. Sets whose prefix
   holds fewer shingles of other sets than that cannot be linked and leave: once with ``l`` a twentieth of the set, then,
   among those left, with two fifths, so that a passage that many documents share does not keep them.
3. Sets that share a shingle of the prefix are candidates; their connected parts, found over one pivot per shingle, are
   cut into tiles: a band of sizes (a factor of 1.25) with the band below, in blocks of bounded size, block against
   block. Every pair that may be linked meets in one tile, whatever number of shingles it shares.
4. In a tile hashed bitmaps come first: half of ``n + m - bits that differ`` bounds the overlap from above. Sets with a
   partner that passes meet again with their sorted arrays, which are intersected exactly, most promising pairs first;
   pairs that links found before in the tile connect already are skipped, so a tile yields fewer links than sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import Scratch, WordHash, among, in_chunks, mix64, spread_join, words_of

SHINGLE = 5
#: Bits of a set's signature for each shingle (up to a power of two), shingles in a block of a tile (8 MB).
SIGNATURE, BLOCK = 8, 1_000_000
#: Shares of a set by which the prefixes of the first and second filter are longer than the plain one.
FIRST, SECOND = 0.05, 0.4
#: Bits of the bitmap of texts whose sets are built a second time (8 MB, whatever the input).
BITS = 1 << 26
#: Bits of that bitmap which come to the driver as one value (8 kB).
PAGE = 1 << 16


def shingle_sets(texts: list[str | None], cache: WordHash) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than five words make one shingle, none make none."""
    split = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    words = cache.of([w for ws in split for w in ws])
    n = len(words)
    grams = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    with np.errstate(over="ignore"):
        for o in range(SHINGLE):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[o:o + len(grams)]
    grams = mix64(grams)
    out, at = [], 0
    for k in lengths.tolist():
        if k >= SHINGLE:
            g = np.sort(grams[at:at + k - SHINGLE + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif k:
            h = np.array([k], np.uint64)
            with np.errstate(over="ignore"):
                for w in words[at:at + k]:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + w
            out.append(mix64(h))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def _ceil80(n: int) -> int:
    return -(-4 * n // 5)


def prefix_size(n: int) -> int:
    return n - _ceil80(n) + max(1, int(n * FIRST))


def _sid(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, t64, n, sid, s64, keys; keys only for the first row of a set in this task."""
    cache, seen = WordHash(), set()
    for batch in batches:
        for begin, end, texts in in_chunks(batch, "text"):
            sets = shingle_sets(texts, cache)
            sids = [_sid(s) if len(s) else None for s in sets]
            keys = []
            for s, sid in zip(sets, sids, strict=True):
                keys.append(None if sid is None or sid in seen else s[:prefix_size(len(s))].view(np.int64))
                seen.add(sid)
            rows = batch.slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays([
                rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.binary()),
                pa.array([None if s is None else int.from_bytes(s[:8], "little", signed=True) for s in sids], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "t64", "n", "sid", "s64", "keys"])


def signature(s: np.ndarray) -> bytes:
    """Bitmap of the shingles' hashes, as wide as the least power of two of SIGNATURE bits a shingle; 64 at least."""
    width = max(64, 1 << (SIGNATURE * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s >> np.uint64(8)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """The bitmap at a smaller width in bytes: halves laid over each other."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width)).view(np.uint64)


def may_link(n: np.ndarray, m: int, differ: np.ndarray) -> np.ndarray:
    """By how much the bound of the overlap, half of what the sizes and differing bits leave, exceeds the least one (times 9)."""
    return 9 * ((n + m - differ) // 2) - 4 * (n + m)


def _arrays(bitmap):
    """sid, s64, n, shingles, bits of the texts whose hash is in the bitmap; each set once in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen, known = WordHash(), set(), bitmap.value
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(BITS - 1)
            batch = batch.filter(pa.array(((known[t >> np.uint64(3)] >> (t & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)))
            for _, _, texts in in_chunks(batch, "text"):
                out = []
                for s in shingle_sets(texts, cache):
                    if len(s) and (sid := _sid(s)) not in seen:
                        seen.add(sid)
                        out.append((sid, int.from_bytes(sid[:8], "little", signed=True), len(s), s.view(np.int64), signature(s)))
                if out:
                    sid, s64, n, s, bits = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), pa.array(s64, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["sid", "s64", "n", "shingles", "bits"])

    return run


def tile_groups(batches: Iterator[pa.RecordBatch], found) -> Iterator[list]:
    """``found(rows)`` for the rows of each tile; rows come sorted by tile, their first column, and are yielded by batch."""
    tile, rows = None, []
    for batch in batches:
        out = []
        for r in zip(*[c if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns], strict=True):
            if r[0] != tile:
                out += found(rows) if rows else []
                tile, rows = r[0], []
            rows.append(r)
        yield out
    yield found(rows) if rows else []


def _partners(rows: list[tuple], bits: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, js, room): what sizes and bitmaps let through among rows (tile, block, home, sid, n, ...); j comes after i."""
    side, home, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[4] for r in rows], np.int64)
    width = min(map(len, bits))
    table = np.stack([folded(b, width) for b in bits])
    one = len(set(side.tolist())) == 1
    for i in range(len(rows)):
        js = np.arange(i + 1, len(rows))
        js = js[(home[js] | home[i]) & (5 * np.minimum(n[js], n[i]) >= 4 * np.maximum(n[js], n[i])) & (one | (side[js] != side[i]))]
        if len(js):
            room = may_link(n[js], n[i], np.bitwise_count(table[js] ^ table[i]).sum(1, dtype=np.int64))
            if len(js := js[ok := room >= 0]):
                yield i, js, room[ok]


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that have a partner in a tile, by bitmaps: (tile, block, home, sid, n, bits) -> sid."""
    def found(rows: list[tuple]) -> list[bytes]:
        out = set()
        for i, js, _ in _partners(rows, [r[5] for r in rows]):
            out |= {i, *js.tolist()}
        return [rows[i][3] for i in out]

    for sids in tile_groups(batches, found):
        yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary())], ["sid"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect what is linked in a tile: (tile, block, home, sid, n, shingles) -> x, y."""
    def found(rows: list[tuple]) -> list[tuple]:
        sets = [r[5].values.to_numpy(zero_copy_only=False).view(np.uint64) for r in rows]
        pairs = [(-int(v), i, int(j)) for i, js, room in _partners(rows, [signature(s) for s in sets]) for j, v in zip(js, room, strict=True)]
        group, out = list(range(len(rows))), []

        def root(i: int) -> int:
            while group[i] != i:
                group[i] = i = group[group[i]]
            return i

        for _, i, j in sorted(pairs):
            a, b = root(i), root(j)
            if a != b:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    group[a] = b
                    out.append((rows[i][3], rows[j][3]))
        return out

    for links in tile_groups(batches, found):
        a, b = zip(*links, strict=True) if links else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["x", "y"])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """sid, comp (least one reachable) of all ends of ``edges(x, y)``: least label of the neighbours, then label of the label."""
    both = scratch.put(edges.select("x", "y").union(edges.select("y", "x")).distinct(), f"{name}_edges")
    labels = both.groupBy(F.col("x").alias("sid")).agg(F.least(F.col("sid"), F.min("y")).alias("comp"))
    labels = scratch.put(labels, f"{name}_0")
    k = 0
    while True:
        k += 1
        near = both.join(labels, F.col("y") == F.col("sid")).groupBy("x").agg(F.min("comp").alias("near"))
        stepped = labels.join(near, F.col("sid") == F.col("x")).select("sid", "comp", F.least("comp", "near").alias("new"))
        up = labels.select(F.col("sid").alias("new"), F.col("comp").alias("up"))
        nxt = scratch.put(stepped.join(up, "new").select("sid", F.col("comp").alias("old"), F.least("new", "up").alias("comp")), f"{name}_{k}")
        changed = nxt.where("comp <> old").limit(1).count()
        scratch.drop(f"{name}_{k - 1}")
        labels = nxt.select("sid", "comp")
        if not changed:
            return labels


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page, bits for rows (page, at, bits) sorted by page: the 64-bit words of a page as one value."""
    page, held = None, np.zeros(PAGE // 64, np.int64)
    for batch in batches:
        out = []
        pages, at, bits = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.flatnonzero(np.diff(pages)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pages)], strict=True):
            if begin < end and pages[begin] != page:
                if page is not None:
                    out.append((page, held.tobytes()))
                page = int(pages[begin])
                held[:] = 0
            held[at[begin:end]] = bits[begin:end]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["page", "bits"])
    if page is not None:
        yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["page", "bits"])


def text_bitmap(hashes: DataFrame) -> np.ndarray:
    """Fixed-size bitmap of ``hashes(t64)``: its pages of PAGE bits reach the driver, BITS / 8 bytes at most."""
    words = hashes.select(F.col("t64").bitwiseAND(BITS - 1).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    pages = words.select(F.floor(F.col("w") / (PAGE // 64)).cast("int").alias("page"), (F.col("w") % (PAGE // 64)).cast("int").alias("at"), "bits")
    pages = pages.repartition("page").sortWithinPartitions("page").mapInArrow(_pages, "page int, bits binary")
    bitmap = np.zeros(BITS // 8, np.uint8)
    for r in pages.collect():
        bitmap[r["page"] * (PAGE // 8):(r["page"] + 1) * (PAGE // 8)] = np.frombuffer(r["bits"], np.uint8)
    return bitmap


def _enough(rows: DataFrame, built: DataFrame, share: float) -> DataFrame:
    """s64, n of the sets of ``rows(s64, h)`` of which enough shingles are also those of another set.

    ``rows`` hold the first ``n - ceil(0.8 n) + l`` shingles with ``l = share * n``. A linked set has ``ceil(0.8 n)``
    shingles at least, so the smaller of the two numbers ``l`` is the least that is shared. A set may have been built in
    several tasks (``built(s64, times, n)``); its shingles count that often.
    """
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * 4 / 5) * share)) * F.col("times")
    return rows.groupBy("s64").agg(F.count("*").alias("c")).join(built, "s64").where(F.col("c") >= need).select("s64", "n")


def _met(rows: DataFrame) -> DataFrame:
    """The rows of ``rows(s64, h, ...)`` whose shingle is held by two different sets."""
    same = Window.partitionBy("h")  # one shuffle of the rows, where a join with the shared shingles takes two
    return rows.withColumn("lo", F.min("s64").over(same)).withColumn("hi", F.max("s64").over(same)).where("lo <> hi").drop("lo", "hi")


def _parts(met: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """s64, part of the sets ``sets(s64, n)`` that share a shingle of ``met`` with one another, in bands of like size."""
    band = _band(F.col("n"))
    tiles = met.where("core").join(sets, "s64").select("s64", F.explode(F.array(F.xxhash64("h", band), F.xxhash64("h", band + 1))).alias("tile"))
    pivots = tiles.groupBy("tile").agg(F.min("s64").alias("pivot"), F.max("s64").alias("last")).where("pivot <> last").select("tile", "pivot")
    edges = tiles.join(pivots, "tile").where("s64 <> pivot").select(F.col("s64").alias("x"), F.col("pivot").alias("y")).distinct()
    return components(edges, scratch, "parts").select(F.col("sid").alias("s64"), F.col("comp").alias("part"))


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25)))


def _tiles(sets: DataFrame) -> DataFrame:
    """tile, block, home, sid for ``sets(sid, n, part)``: each part by bands of sizes, blocks against blocks."""
    banded = sets.select("sid", "n", "part", F.explode(F.array(F.struct(_band(F.col("n")).alias("band"), F.lit(True).alias("home")), F.struct((_band(F.col("n")) + 1).alias("band"), F.lit(False).alias("home")))).alias("b")) \
        .select("sid", "n", "b.home", F.xxhash64("part", "b.band").alias("tile"))
    held = banded.groupBy("tile").agg(F.count("*").alias("rows"), F.sum("n").alias("size"), F.max("home").alias("any")).where("any and rows > 1").select("tile", (F.col("size") / BLOCK).cast("int").alias("more"))
    rows = banded.join(held, "tile").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("more") + 1).cast("int"))
    spread = rows.select("tile", "block", "home", "sid", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("other"))
    return spread.select(F.xxhash64("tile", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "block", "home", "sid")


def set_links(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(members, labels): doc_id, n, sid of every row of ``docs(doc_id, text)``; sid, comp of the sets that are linked."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("t64"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = scratch.put(texts.mapInArrow(_sets, f"doc_id {kind}, t64 long, n long, sid binary, s64 long, keys array<long>"), "keys")
    members = scratch.put(both.select("doc_id", "t64", "n", "sid", "s64", F.col("keys").isNotNull().alias("keyed")), "members")
    keys = both.where("keys is not null").select("s64", "keys", (F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1).alias("cores"))
    rows = keys.select("s64", F.posexplode("keys").alias("pos", "h"), "cores").select("h", "s64", (F.col("pos") < F.col("cores")).alias("core"))
    met = scratch.put(_met(rows), "met")
    scratch.drop("keys")
    built = members.where("keyed").groupBy("s64").agg(F.count("*").alias("times"), F.min("n").alias("n"), F.min("t64").alias("t64"))
    built = scratch.put(built, "built")
    active = scratch.put(_enough(met, built.drop("t64"), FIRST).join(built.select("s64", "t64"), "s64"), "active")
    bitmap = spark.sparkContext.broadcast(text_bitmap(active))
    arrays = scratch.put(texts.select("t64", "text").mapInArrow(_arrays(bitmap), "sid binary, s64 long, n long, shingles array<long>, bits binary"), "arrays")
    # The same test again over more than half of the shingles, among the sets that are left.
    longer = (F.col("n") - F.ceil(F.col("n") * 4 / 5) + F.greatest(F.lit(1), F.floor(F.col("n") * SECOND))).cast("int")
    more = arrays.select("s64", F.explode(F.slice("shingles", F.lit(1), longer)).alias("h"))
    again = arrays.groupBy("s64").agg(F.count("*").alias("times"), F.min("n").alias("n"))
    likely = scratch.put(_enough(_met(more), again, SECOND), "likely")
    parts = _parts(met, likely, scratch)
    grouped = arrays.groupBy("s64", "sid").agg(F.first("n").alias("n")).join(parts, "s64").select("sid", "n", "part")
    grouped = scratch.put(grouped, "grouped")
    by_bits = arrays.groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    first = _tiles(grouped).join(by_bits, "sid").select("tile", "block", "home", "sid", "n", "bits").repartition("tile").sortWithinPartitions("tile")
    some = scratch.put(first.mapInArrow(_promising, "sid binary").distinct(), "promising")
    exact = arrays.join(some, "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    second = _tiles(grouped.join(some, "sid", "left_semi")).join(exact, "sid").select("tile", "block", "home", "sid", "n", "shingles").repartition("tile").sortWithinPartitions("tile")
    links = second.mapInArrow(_linked, "x binary, y binary")
    return members, components(links, scratch, "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs(doc_id, text)``; component_id is the least doc_id reachable.

    A row without words (null, empty or white space) is linked with nothing and has its own doc_id. Repeated rows are
    linked with each other; a null doc_id takes part and is never the least, unless its component has no other.
    Other columns are ignored; an empty table gives an empty result.
    """
    members, labels = set_links(docs, Scratch(docs.sparkSession, "jaccard"))
    named = members.select("doc_id", "n", "sid").join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, all columns: that of the least doc_id, then of the least text hash.

    Rows are told apart by doc_id and text, so a repeated doc_id (or a null one) loses only the texts that are copies. A
    null doc_id is kept only if its component has no other. Of rows that repeat both doc_id and text one stays. Rows without
    words stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "one_of_each")
    members, labels = set_links(docs.select("doc_id", "text"), scratch)
    named = members.select("doc_id", "t64", "sid").join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")).where("comp is not null")
    keys = scratch.put(named.groupBy("comp", "doc_id", "t64").agg(F.count("*").alias("times")), "keys")
    first = keys.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t64")).alias("first"), F.count("*").alias("rows"))
    ruled = spread_join(keys, scratch.put(first, "first"), "comp", "rows", F.col("t64"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t64") == F.col("first.t64"))
    ruled = scratch.put(ruled.select("doc_id", F.col("t64").alias("_t64"), "times", is_first.alias("stays")), "ruled")
    names = ["doc_id", "_t64"]
    left, _ = among(docs.withColumn("_t64", F.xxhash64("text")), ruled.where("not stays").select(names), names)
    again = ruled.where("stays and times > 1").select(names)
    if not again.limit(1).count():
        return left.drop("_t64")
    once, repeated = among(left, again, names)
    return once.unionByName(repeated.dropDuplicates(names)).drop("_t64")
