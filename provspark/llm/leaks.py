"""Benchmark decontamination by spaced seeds.

Words are compared lower-cased, ASCII punctuation counting as white space. Fixed masks take four of five neighbouring
words, or four in a row, and ignore the rest. Every window of ``min(item length, 20)`` words in which at most a fifth
were replaced holds a hit of one of the masks (shown by trying all patterns, see the tests), so the search loses no
leak. Hashes of training texts are first held against a bitmap of fixed size made from the benchmark's; what passes is
joined with the benchmark's seeds, and the words around the hits are compared along the hit's diagonal.

Texts are whole; null and empty ones, and items of fewer than five words, have no leaks. Copies of a document are
verified once and each gets its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import LOWER, Scratch, WordHash, among, in_chunks, mix64

#: Positions of the words that a seed reads.
MASKS = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))
WINDOW, SHARE = 20, 0.8
LEAST_WORDS = 5
#: Bits of the bitmap that training hashes are held against (2 MB); each seed sets two.
BITS = 1 << 24
_SPACED = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else LOWER[b] for b in range(256))


def spaced_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split() if text else []


def seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """The mask's hash at every position it fits."""
    places = MASKS[mask]
    n = len(words) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(mask + 1))
    with np.errstate(over="ignore"):
        for o in places:
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[o:o + n]
    return mix64(h)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHash()
    for batch in batches:
        ids, items, masks, places, hashes, words = [], [], [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = cache.of(spaced_words(text))
            if len(w) < LEAST_WORDS:
                continue
            ids.append(key)
            items.append([s.view(np.int64).tolist() for s in (seeds(w, m) for m in range(len(MASKS)))])
            words.append(w.view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.list_(pa.int64())))], ["item_id", "words", "seeds"])


def benchmark_seeds(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """item_id, words, seeds (hashes by mask and position)."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return scratch.put(rows.mapInArrow(_item_rows, "item_id long, words array<long>, seeds array<array<long>>"), "items")


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(BITS - 1), (h >> np.uint64(32)) & np.uint64(BITS - 1)


def seed_bitmap(items: DataFrame) -> np.ndarray:
    """Bitmap of all seeds as bytes; as many rows reach the driver as it has 64-bit words, whatever the benchmark's size."""
    h = items.select(F.explode(F.flatten("seeds")).alias("h"))
    slot = h.select(F.explode(F.array(F.col("h").bitwiseAND(BITS - 1), F.shiftrightunsigned("h", 32).bitwiseAND(BITS - 1))).alias("s"))
    words = slot.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).collect()
    bitmap = np.zeros(BITS // 64, np.int64)
    for r in words:
        bitmap[r["w"]] = r["bits"]
    return bitmap.view(np.uint8)


def _regions(bitmap):
    """Rows (doc_id, blob, start, words, hits) around the hits of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cache, bits = WordHash(), bitmap.value
        for batch in batches:
            for begin, _, texts in in_chunks(batch, "text"):
                split = [spaced_words(t) for t in texts]
                lengths = np.fromiter(map(len, split), np.int64, len(split))
                words = cache.of([w for ws in split for w in ws])
                ends = np.cumsum(lengths)
                owner = np.repeat(np.arange(len(split)), lengths)
                hit_at, hit_hash = [], []
                for m, places in enumerate(MASKS):
                    h = seeds(words, m)
                    a, b = _slots(h)
                    ok = np.flatnonzero((bits[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & 1)
                    bb = b[ok]
                    ok = ok[((bits[bb >> np.uint64(3)] >> (bb & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
                    ok = ok[owner[ok] == owner[ok + places[-1]]]  # not across two texts
                    hit_at.append(ok)
                    hit_hash.append(h[ok])
                at, hashes = np.concatenate(hit_at), np.concatenate(hit_hash)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                cuts = np.flatnonzero((np.diff(at) > 2 * WINDOW) | (np.diff(owner[at]) != 0)) + 1
                out = {k: [] for k in ("doc", "blob", "start", "words", "hits")}
                for part in np.split(np.arange(len(at)), cuts):
                    d = int(owner[at[part[0]]])
                    first, last = ends[d] - lengths[d], ends[d]
                    lo, hi = max(first, at[part[0]] - WINDOW), min(last, at[part[-1]] + WINDOW + 5)
                    out["doc"].append(begin + d)
                    out["blob"].append(xxhash.xxh3_128_digest(texts[d].encode("utf-8", "surrogatepass")))
                    out["start"].append(int(lo - first))
                    out["words"].append(words[lo:hi].view(np.int64))
                    out["hits"].append([{"pos": int(p - first), "h": int(x)} for p, x in zip(at[part], hashes[part].view(np.int64), strict=True)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(out["doc"])), pa.array(out["blob"], pa.binary()), pa.array(out["start"], pa.int64()), pa.array(out["words"], pa.list_(pa.int64())),
                    pa.array(out["hits"], pa.list_(pa.struct([("pos", pa.int64()), ("h", pa.int64())])))], ["doc_id", "blob", "start", "words", "hits"])

    return run


def overlap(words: np.ndarray, start: int, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Equal words and place of the best window along a diagonal (text position minus item position): (equal, size, text position)."""
    size = min(len(item), WINDOW)
    lo, hi = max(start, diagonal), min(start + len(words), diagonal + len(item))
    if hi - lo < size:
        return 0, size, -1
    same = np.concatenate([[0], np.cumsum(words[lo - start:hi - start] == item[lo - diagonal:hi - diagonal])])
    sums = same[size:] - same[:-size]
    best = int(np.argmax(sums))
    return int(sums[best]), size, lo + best


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            w, item = np.array(r["words"]), np.array(r["item_words"])
            found = max(overlap(w, r["start"], item, d) for d in r["diagonals"])
            if found[0] >= found[1] - int(found[1] * (1 - SHARE) + 1e-9):
                out.append((r["blob"], r["item_id"], *found))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["blob", "item_id", "equal", "size", "position"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, equal, size, position: each pair of a document and a benchmark item whose words it holds.

    ``equal`` of the ``size`` words in the best window agree; ``position`` is its first word in the document, the first
    of the best. Pairs come once, repeated or null doc_ids too. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    items = benchmark_seeds(benchmark, scratch)
    bitmap = spark.sparkContext.broadcast(seed_bitmap(items))
    regions = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _regions(bitmap), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, blob binary, start long, words array<long>, hits array<struct<pos:long,h:long>>")
    regions = scratch.put(regions, "regions")
    hits = regions.select("blob", "start", F.explode("hits").alias("hit")).select("blob", "start", "hit.pos", "hit.h")
    seed = items.select("item_id", F.explode("seeds").alias("s")).select("item_id", F.posexplode("s").alias("item_pos", "h"))
    pairs = hits.join(seed, "h").groupBy("blob", "start", "item_id").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("diagonals"))
    texts = regions.groupBy("blob", "start").agg(F.first("words").alias("words"))
    rows = pairs.join(texts, ["blob", "start"]).join(items.select("item_id", F.col("words").alias("item_words")), "item_id")
    found = rows.select("blob", "start", "words", "item_id", "item_words", "diagonals").mapInArrow(_verify, "blob binary, item_id long, equal long, size long, position long")
    best = found.groupBy("blob", "item_id").agg(F.max(F.struct("equal", "size", (-F.col("position")).alias("back"))).alias("m"))
    return regions.select("doc_id", "blob").distinct().join(best, "blob").groupBy("doc_id", "item_id").agg(F.max("m").alias("m")) \
        .select("doc_id", "item_id", F.col("m.equal").alias("equal"), F.col("m.size").alias("size"), (-F.col("m.back")).alias("position"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; a row with a null id is kept if no text under that id does."""
    bad = Scratch(docs.sparkSession, "with_leaks").put(leaks(docs, benchmark).select("doc_id").distinct(), "ids")
    return among(docs, bad, ["doc_id"])[0]
