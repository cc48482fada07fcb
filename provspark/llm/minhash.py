"""Near-duplicates by bottom-k sketches of one hash function, exact links on full sets (Jaccard of 0.8 or more).

1. Every text becomes its set of hashed 2-word shingles; the ``K`` least values are its sketch. Texts with equal sets are
   one set from here on.
2. Inverted lists of retained values. Sketches of linked sets share ``least_shared`` values at least: certain for sets
   that fit into a sketch; else the shared values among the K least of the union are drawn at a rate of 0.8, and fewer than
   28 of 64 have a chance of 2e-9 for a pair at exactly 0.8, less above. A set therefore enters only the lists of its rarest
   values, all but 27, and none if fewer than 28 of its values are in other sketches at all: texts that share common
   words or a passage do not meet.
3. Each set meets one pivot, the least set of most of its first lists. If the union of their sketches lets them pass,
   the full sets are compared and linked.
4. Lists whose sets are not all connected by then are tiles, cut into blocks of bounded size. In a tile all pairs of sets
   that are not connected, of sizes that may link, are estimated from the union of their sketches; sets with a partner
   that passes meet again with their full sets. Links come from the list of a pair's first common value only.
   A first look takes a bitmap of the sketch, whose common bits bound the common values from above; what has a partner there
   is looked at with the upper halves of the values, with a margin that lets all pass which whole values would. Nothing is
   emitted per pair but links, and of those at most one less than sets in a tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import Scratch, WordHash, in_chunks, mix64, spread_join, words_of
from provspark.llm.jaccard import BITS, components, text_bitmap, tile_groups

#: Words of a shingle, values of a sketch, least number of them that linked sets share.
SHINGLE, K, SHARED = 2, 64, 28
#: Sets in a block of a tile; of its values a set looks for a pivot in the lists of so many.
BLOCK, PIVOTS = 1000, 12
#: A band of sizes is a factor of 1.25 to this power wide. Ranks that upper halves of values may be wrong by.
WIDTH, SLACK = 1, 2
#: Bits of a sketch's bitmap.
SIGNATURE = 512


def shingle_sets(texts: list[str | None], cache: WordHash, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle, none make none."""
    out = []
    with np.errstate(over="ignore"):
        for text in texts:
            w = cache.of(words_of(text))
            if len(w) >= width:
                grams = np.zeros(len(w) - width + 1, np.uint64)
                for o in range(width):
                    grams = grams * np.uint64(0x9E3779B97F4A7C15) + w[o:o + len(grams)]
                out.append(np.unique(mix64(grams)))
            else:
                h = np.array([len(w)], np.uint64)
                for x in w:
                    h = h * np.uint64(0xD6E8FEB86659FD93) + x
                out.append(mix64(h) if len(w) else np.zeros(0, np.uint64))
    return out


def least_shared(n: Column) -> Column:
    return F.least(F.ceil(n * 4 / 5), F.lit(SHARED)).cast("int")


def _sid(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t64, text) -> doc_id, t64, n, sid, s64, sketch; a sketch only for the first row of a set in this task."""
    cache, seen = WordHash(), set()
    for batch in batches:
        for begin, end, texts in in_chunks(batch, "text"):
            sets = shingle_sets(texts, cache)
            sids = [_sid(s) if len(s) else None for s in sets]
            sketches = []
            for s, sid in zip(sets, sids, strict=True):
                sketches.append(None if sid is None or sid in seen else s[:K].view(np.int64))
                seen.add(sid)
            rows = batch.slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays([
                rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.binary()),
                pa.array([None if s is None else int.from_bytes(s[:8], "little", signed=True) for s in sids], pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "t64", "n", "sid", "s64", "sketch"])


def _full_sets(bitmap):
    """(t64, text) -> sid, shingles of the texts whose hash is in the bitmap; each set once in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen, known = WordHash(), set(), bitmap.value
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(BITS - 1)
            batch = batch.filter(pa.array(((known[t >> np.uint64(3)] >> (t & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)))
            for _, _, texts in in_chunks(batch, "text"):
                fresh = {sid: s for s in shingle_sets(texts, cache) if len(s) and (sid := _sid(s)) not in seen}
                seen.update(fresh)
                yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary()), pa.array([s.view(np.int64) for s in fresh.values()], pa.list_(pa.int64()))], ["sid", "shingles"])

    return run


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    common = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * common >= 80 * (len(s) + len(t) - common)


def may_link(n: int, s: np.ndarray, ns: np.ndarray, sketches: np.ndarray, slack: int = 0) -> np.ndarray:
    """Which of the sets of size ``ns`` and sketch ``sketches`` (rows, filled up with the largest value) may link with one
    of size ``n`` and sketch ``s``: exactly if both fit into their sketches, else by the K least values of the union.
    Sketches may hold upper halves of the values, which only adds common values, but may move ranks by ``slack``."""
    length = np.minimum(ns, K)
    real = np.arange(sketches.shape[1]) < length[:, None]
    rank = np.searchsorted(s, sketches.ravel(), side="right").reshape(sketches.shape)
    common = real & (rank > 0) & (s[np.maximum(rank, 1) - 1] == sketches)
    so_far = np.cumsum(common, axis=1)
    both = so_far[:, -1]
    if n <= K:
        exact = 100 * both >= 80 * (n + ns - both)
        if (ns <= K).all():
            return exact
    in_union = (common & (np.arange(sketches.shape[1]) + 1 + rank - so_far <= K + slack)).sum(1)
    estimated = in_union >= SHARED - slack
    return np.where(ns <= K, exact, estimated) if n <= K else estimated


def bitmaps(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``SIGNATURE`` bits, packed, for each sketch: the bits that its values' last digits name."""
    table = np.zeros((len(offsets) - 1, SIGNATURE), bool)
    table[np.repeat(np.arange(len(table)), np.diff(offsets)), (values & values.dtype.type(SIGNATURE - 1)).astype(np.int64)] = True
    return np.packbits(table, axis=1)


def may_share(n: int, bits: np.ndarray, ns: np.ndarray, table: np.ndarray, slack: int = 0) -> np.ndarray:
    """Which of the sets of size ``ns`` and bitmap ``table`` (rows of 64-bit words) share enough retained values with one of
    size ``n`` for a link. Values that fall on a bit of another one of their sketch may hide, no others: common bits and the
    hidden values of the sketch that has fewer bound the common values from above."""
    hidden = np.minimum(ns, K) - np.bitwise_count(table).sum(1, dtype=np.int64)
    own = min(n, K) - int(np.bitwise_count(bits).sum(dtype=np.int64))
    most = np.bitwise_count(table & bits).sum(1, dtype=np.int64) + np.minimum(hidden, own)
    return np.where(np.maximum(ns, n) <= K, 9 * most >= 4 * (n + ns), most >= SHARED - slack)


def _candidates(rows: list[dict], kind: type = np.uint64) -> Iterator[tuple[int, int]]:
    """Pairs of rows of a tile that may link, are not connected yet and belong to this tile.

    With upper halves of values (``uint32``) these and few others: the tile may then be that of the second common value,
    as one common half in some ten thousand pairs stands for different values.
    """
    slack, firsts = (SLACK, 2) if kind is np.uint32 else (0, 1)
    n = np.array([r["n"] for r in rows], np.int64)
    table = np.full((len(rows), K), np.iinfo(kind).max, kind)
    for i, r in enumerate(rows):
        table[i, :len(r["sketch"])] = r["sketch"].values.to_numpy(zero_copy_only=False).view(kind)
    kinds = {c: i for i, c in enumerate(dict.fromkeys(r["comp"] for r in rows))}
    comp = np.array([kinds[r["comp"]] for r in rows])
    home, block = np.array([r["home"] for r in rows]), np.array([r["block"] for r in rows])
    posted = (np.array([r["posted"] for r in rows], np.int64).view(np.uint64)[:, None] >> np.arange(K, dtype=np.uint64) & np.uint64(1)).astype(bool)
    one, v = len(set(block.tolist())) == 1, np.int64(rows[0]["v"]).view(np.uint64)
    # Values with a list that come before this tile's, as unsigned numbers.
    before = posted & (table < kind(v >> np.uint64(32) if kind is np.uint32 else v))
    length = np.minimum(n, K)
    bits = bitmaps(table[np.arange(K) < length[:, None]], np.concatenate([[0], np.cumsum(length)])).view(np.uint64)
    for i in range(len(rows)):
        js = np.arange(i + 1, len(rows))
        ok = (comp[js] != comp[i]) & (home[js] | home[i]) & (5 * np.minimum(n[js], n[i]) >= 4 * np.maximum(n[js], n[i])) & (one | (block[js] != block[i]))
        js = js[ok]
        if len(js):
            js = js[may_share(int(n[i]), bits[i], n[js], bits[js], slack)]
        if len(js) and len(earlier := table[i, before[i]]):
            at = np.minimum(np.searchsorted(earlier, table[js]), len(earlier) - 1)
            js = js[(before[js] & (earlier[at] == table[js])).sum(1) < firsts]
        if len(js):
            for j in js[may_link(int(n[i]), table[i, :min(K, n[i])], n[js], table[js], slack)].tolist():
                yield i, j


def _signed(at: int):
    """The sketch, column ``at`` of the rows, becomes its bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = batch.column(at)
            values = sketch.flatten().to_numpy(zero_copy_only=False)
            bits = pa.array([r.tobytes() for r in bitmaps(values, sketch.offsets.to_numpy())], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(at)], bits], [*batch.schema.names[:at], "bits"])

    return run


LOOK = ["tile", "block", "home", "sid", "kind", "n", "bits"]


def _noticed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a tile that have a partner there by bitmaps: LOOK -> tile, sid."""
    def found(rows: list[tuple]) -> list[tuple]:
        block, home, kind, n = (np.array([r[i] for r in rows]) for i in (1, 2, 4, 5))
        table = np.stack([np.frombuffer(r[6], np.uint64) for r in rows])
        one, seen = (block == block[0]).all(), np.zeros(len(rows), bool)
        for i in range(len(rows) - 1):
            later = slice(i + 1, None)
            js = i + 1 + np.flatnonzero((kind[later] != kind[i]) & (home[later] | home[i]) & (5 * np.minimum(n[later], n[i]) >= 4 * np.maximum(n[later], n[i]))
                                        & (one | (block[later] != block[i])))
            if len(js) and len(js := js[may_share(int(n[i]), table[i], n[js], table[js])]):
                seen[i] = seen[js] = True
        return [(rows[i][0], rows[i][3]) for i in np.flatnonzero(seen).tolist()]

    for out in tile_groups(batches, found):
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], ["tile", "sid"])


TILE = ["tile", "v", "block", "home", "sid", "comp", "n", "posted", "sketch"]


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a tile that have a partner there: TILE with upper halves of the sketch's values -> tile, sid."""
    def found(rows: list[tuple]) -> list[tuple]:
        rows = [dict(zip(TILE, r, strict=True)) for r in rows]
        return [(rows[i]["tile"], rows[i]["sid"]) for i in {i for pair in _candidates(rows, np.uint32) for i in pair}]

    for out in tile_groups(batches, found):
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], ["tile", "sid"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a tile that connect what was not connected: TILE and shingles -> x, y."""
    def found(rows: list[tuple]) -> list[tuple]:
        rows = [dict(zip([*TILE, "shingles"], r, strict=True)) for r in rows]
        sets = [r["shingles"].values.to_numpy(zero_copy_only=False).view(np.uint64) for r in rows]
        group: dict[bytes, bytes] = {r["comp"]: r["comp"] for r in rows}

        def root(c: bytes) -> bytes:
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c

        out = []
        for i, j in _candidates(rows):
            a, b = root(rows[i]["comp"]), root(rows[j]["comp"])
            if a != b and linked(sets[i], sets[j]):
                group[a] = b
                out.append((rows[i]["sid"], rows[j]["sid"]))
        return out

    for out in tile_groups(batches, found):
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["x", "y"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, pivot, n, sketch, n of pivot, sketch of pivot) -> sid, pivot of those that may link."""
    for batch in batches:
        n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        s, t = ([x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in batch.column(i)] for i in (3, 5))
        sizes = 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)
        keep = [ok and bool(may_link(int(n[i]), s[i], m[i:i + 1], t[i][None])[0]) for i, ok in enumerate(sizes.tolist())]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, pivot, shingles, of_pivot) -> x, y of the linked ones."""
    for batch in batches:
        x, y = batch.column(0), batch.column(1)
        own, other = (batch.column(i) for i in (2, 3))
        arrays = [(c.values.to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy()) for c in (own, other)]
        (s, a), (t, b) = arrays
        keep = pa.array([linked(s[a[i]:a[i + 1]], t[b[i]:b[i + 1]]) for i in range(batch.num_rows)], pa.bool_())
        yield pa.RecordBatch.from_arrays([x, y], ["x", "y"]).filter(keep)


def _bands(rows: DataFrame) -> DataFrame:
    """Each row in the band of its size, its home, and in the next one if a size that it may link with lies there; a list
    and a band are a tile. Any two sizes that may link meet in the home of the larger."""
    def band(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / F.lit(WIDTH * math.log(1.25)))

    home, next_ = band(F.col("n")), band(F.col("n") * 1.25)
    both = F.when(next_ > home, F.array(F.struct(home.alias("band"), F.lit(True).alias("home")), F.struct(next_.alias("band"), F.lit(False).alias("home")))) \
        .otherwise(F.array(F.struct(home.alias("band"), F.lit(True).alias("home"))))
    return rows.withColumn("_b", F.explode(both)).withColumn("home", F.col("_b.home")).withColumn("tile", F.xxhash64("v", "_b.band")).drop("_b")


def posted_values(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """s64, posted for the sets of ``sets(s64, n, sketch)`` that may have a partner, rarest values first.

    s64 is half of a set's id. Two sets that agree on it count as one here: it then posts what both would, or more.
    """
    values = sets.select("s64", F.explode("sketch").alias("v"))
    lists = values.groupBy("v").agg(F.count("*").alias("rows")).where("rows > 1")
    lists = scratch.put(lists.withColumn("df", F.col("rows")), "lists")
    known = spread_join(values, lists, "v", "rows", F.col("s64")).where("df is not null")
    held = known.groupBy("s64").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))
    least = sets.groupBy("s64").agg(F.min(least_shared(F.col("n"))).alias("least"))
    return held.join(least, "s64").where(F.size("held") >= F.col("least")).select("s64", F.expr("transform(held, x -> x.v)").alias("held"), "least") \
        .select("s64", F.slice("held", F.lit(1), F.size("held") - F.col("least") + 1).alias("posted"))


def set_links(texts: DataFrame, sets: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """x, y: links that connect all linked sets of ``sets(sid, s64, n, sketch, t64)``, whose texts are among ``texts(t64, text)``."""
    spark = texts.sparkSession
    posted = scratch.put(sets.select("sid", "s64", "n", "t64").join(posted_values(sets, scratch), "s64").drop("s64"), "posted")
    scratch.drop("lists")
    lists = posted.select("sid", F.explode(F.slice("posted", 1, PIVOTS)).alias("v"))
    pivots = scratch.put(lists.groupBy("v").agg(F.min("sid").alias("pivot"), F.count("*").alias("rows")).where("rows > 1"), "pivots")
    near = spread_join(lists, pivots, "v", "rows", F.col("sid")).where("sid <> pivot").groupBy("sid", "pivot").count()
    stars = scratch.put(near.groupBy("sid").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot")), "stars")
    stars = beside(stars, sets.select("sid", "n", "sketch"), ["n", "sketch"], scratch, "star_sketches")
    stars = scratch.put(stars.mapInArrow(_estimated, "sid binary, pivot binary"), "likely_stars")
    met = scratch.put(stars.select("sid").union(stars.select("pivot")).distinct().join(posted.select("sid", "t64"), "sid"), "star_sets")
    full = full_sets(texts, met, scratch, "star_full")
    pairs = beside(stars, full, ["shingles"], scratch, "pivots_full")
    first = scratch.put(pairs.mapInArrow(_compared, "x binary, y binary"), "first")
    scratch.drop("star_full")
    scratch.drop("pivots_full")
    # Lists whose sets are not connected by that; what a list holds is told apart by 64 bits of the components' ids.
    labelled = posted.join(components(first, scratch, "stars"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    labelled = scratch.put(labelled, "labelled")
    kinds = labelled.select(F.explode("posted").alias("v"), F.xxhash64("comp").alias("kind")).groupBy("v").agg(F.count("*").alias("rows"), F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    open_lists = scratch.put(kinds.where("lo <> hi").select("v", "rows", F.lit(True).alias("open")), "open_lists")
    rows = spread_join(labelled.select("sid", "n", F.explode("posted").alias("v")), open_lists, "v", "rows", F.col("sid")).where("open")
    tiles = scratch.put(_bands(rows).select("tile", "v", "home", "sid"), "open_tiles")
    held = tiles.groupBy("tile").agg(F.count("*").alias("rows"), F.max("home").alias("any")).where("any and rows > 1").select("tile", "rows", F.floor(F.col("rows") / block).cast("int").alias("more"))
    rows = spread_join(tiles, scratch.put(held, "held"), "tile", "rows", F.col("sid")).where("more is not null")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("more") + 1).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("more"))))
    rows = rows.withColumn("tile", F.xxhash64("tile", F.least("block", "other"), F.greatest("block", "other"))).select("tile", "v", "block", "home", "sid")
    rows = scratch.put(rows, "open_rows")
    # Which of a sketch's values have a list, as bits.
    bits = F.expr("aggregate(transform(sketch, (x, i) -> if(array_contains(posted, x), shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    known = labelled.select("sid", "n", "comp", "posted").join(sets.select("sid", "sketch"), "sid").select("sid", "n", "comp", bits.alias("posted"), "sketch")
    dealt = lambda df: df.repartition("tile").sortWithinPartitions("tile")
    signed = known.select("sid", F.xxhash64("comp").alias("kind"), "n", "sketch").mapInArrow(_signed(3), "sid binary, kind long, n long, bits binary")
    noticed = scratch.put(dealt(rows.drop("v").join(signed, "sid").select(LOOK)).mapInArrow(_noticed, "tile long, sid binary"), "noticed")
    halves = known.withColumn("sketch", F.expr("transform(sketch, x -> cast(shiftright(x, 32) as int))"))
    likely = rows.join(noticed, ["tile", "sid"], "left_semi").join(halves, "sid")
    some = scratch.put(dealt(likely.select(TILE)).mapInArrow(_promising, "tile long, sid binary"), "promising")
    exact = rows.join(some, ["tile", "sid"], "left_semi").join(known, "sid")
    met = scratch.put(some.select("sid").distinct().join(posted.select("sid", "t64"), "sid"), "open_sets")
    full = full_sets(texts, met, scratch, "open_full")
    second = scratch.put(dealt(exact.join(full, "sid").select(*TILE, "shingles")).mapInArrow(_links, "x binary, y binary"), "second")
    return first.union(second)


def beside(stars: DataFrame, known: DataFrame, columns: list[str], scratch: Scratch, name: str) -> DataFrame:
    """sid, pivot, then ``columns`` of ``known`` for sid and for pivot; a pivot may have any number of sets."""
    pivots = stars.groupBy("pivot").agg(F.count("*").alias("rows")).join(known.select(F.col("sid").alias("pivot"), *[F.col(c).alias(f"{c}_p") for c in columns]), "pivot")
    both = spread_join(stars.join(known, "sid"), scratch.put(pivots, name), "pivot", "rows", F.col("sid"))
    return both.select("sid", "pivot", *columns, *[f"{c}_p" for c in columns])


def full_sets(texts: DataFrame, met: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """sid, shingles of the sets of ``met(sid, t64)``, from the texts that a bitmap of fixed size lets through."""
    bitmap = texts.sparkSession.sparkContext.broadcast(text_bitmap(met))
    full = texts.select("t64", "text").mapInArrow(_full_sets(bitmap), "sid binary, shingles array<long>")
    return scratch.put(full.join(met.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.first("shingles").alias("shingles")), name)


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text)``; component_id is the least doc_id
    reachable, and ``kept`` tells whether it is the row's own.

    A row without words (null, empty or white space) is linked with nothing and keeps its own doc_id. Repeated rows are
    linked with each other; rows that share the least doc_id are all kept. A null doc_id takes part and is never the
    least, unless its component has no other; then its rows are kept. Other columns are ignored; an empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("t64"), F.col("text").cast("string").alias("text"))
    both = scratch.put(texts.mapInArrow(_sketches, f"doc_id {kind}, t64 long, n long, sid binary, s64 long, sketch array<long>"), "sketches")
    keyed = scratch.put(both.select("doc_id", "n", "sid"), "members")
    sets = both.where("sketch is not null").groupBy("sid", "s64").agg(F.max("n").alias("n"), F.first("sketch").alias("sketch"), F.min("t64").alias("t64"))
    sets = scratch.put(sets, "sets")
    scratch.drop("sketches")
    labels = components(set_links(texts, sets, scratch, block), scratch, "links")
    by_set = keyed.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    by_set = scratch.put(by_set.join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")), "by_set")
    by_comp = scratch.put(by_set.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("sets")), "by_comp")
    named = scratch.put(spread_join(by_set.select("sid", "comp", "rows"), by_comp, "comp", "sets", F.col("sid")).select("sid", "rows", "component_id"), "named")
    out = spread_join(keyed.select("doc_id", "n", "sid"), named, "sid", "rows", F.col("doc_id"))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
