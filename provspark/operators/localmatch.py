"""Local geometric matching: usable features, candidates, descriptor matching and the geometric gate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions import boxes as B
from provspark.operators.skew import sliced_row_number, top_per_key
from provspark.session import cut_lineage

# Feature version, extractors and match tuning.
FEATURE_VERSION = 1
EXTRACTORS = ("orb", "akaze")
ORB_MIN_KEYPOINTS = 140
RATIO_TEST = 0.72
MIN_GOOD_MATCHES = 24
MIN_INLIERS = 16
MIN_INLIER_RATIO = 0.45
MIN_SUPPORT = 0.10
MIN_PRIMARY_COVERAGE = 0.12
MIN_SECONDARY_COVERAGE = 0.01

# Keypoints per block: the unit of descriptor matching. Two blocks give a 512 x 512 distance table in one task.
BLOCK = 512


def feature_valid(features: DataFrame) -> DataFrame:
    """Feature rows of the current version, a known extractor and a non-empty frame."""
    return features.filter(
        (F.col("feature_version") == FEATURE_VERSION) & F.col("extractor").isin(*EXTRACTORS)
        & (F.col("width") > 0) & (F.col("height") > 0)
    )


def feature_select(features: DataFrame, akaze_fallback: bool = True) -> DataFrame:
    """Extractor to keep per image from its per-extractor keypoint counts."""
    def count_of(name: str) -> Column:
        return F.max(F.when(F.col("extractor") == name, F.col("keypoint_count")))

    counts = features.groupBy("image_id").agg(count_of("orb").alias("orb"), count_of("akaze").alias("akaze"))
    orb, akaze = F.col("orb"), F.col("akaze")
    if akaze_fallback:
        pick = (
            F.when(orb >= ORB_MIN_KEYPOINTS, "orb").when(akaze.isNotNull() & (orb.isNull() | (akaze >= orb)), "akaze")
            .when(orb.isNotNull(), "orb")
        )
    else:
        pick = F.when(orb.isNotNull(), "orb")
    n = F.when(F.col("extractor") == "orb", orb).otherwise(akaze)
    chosen = counts.withColumn("extractor", pick).filter("extractor is not null")
    return chosen.select("image_id", "extractor", n.cast("bigint").alias("keypoint_count"))


def _descriptor_keys(keypoints: DataFrame, image: str) -> DataFrame:
    """Distinct (image, part, value) of the eight 32-bit parts of an image's descriptors."""
    low = F.lit(0xFFFFFFFF)
    parts = F.array(*[x for d in ("d0", "d1", "d2", "d3") for x in (F.shiftrightunsigned(d, 32), F.col(d).bitwiseAND(low))])
    return keypoints.select(F.col("image_id").alias(image), F.posexplode(parts).alias("part", "value")).filter("value is not null").distinct()


def local_candidates(queries: DataFrame, keypoints: DataFrame, usable: DataFrame, budget: int | None = None,
                     enabled: bool = True) -> DataFrame:
    """Images worth matching with each query image: those that share a 32-bit part of some descriptor with it.

    ``queries(query_id, registry_id)`` x ``keypoints(image_id, d0..d3)`` of images with ``usable(image_id)`` features ->
    ``(query_id, candidate_id, shared, candidate_rank)``, most shared parts first, then by id. By pigeonhole every two
    descriptors within seven bits share a part. ``budget`` keeps so many candidates of a query; by default all stay.
    """
    ids = usable.select(F.col("image_id").alias("candidate_id")).distinct()
    if not enabled:
        ids = ids.limit(0)
    mine = queries.select("query_id", "registry_id").join(_descriptor_keys(keypoints, "registry_id"), "registry_id")
    theirs = _descriptor_keys(keypoints, "candidate_id").join(ids, "candidate_id", "left_semi")
    shared = mine.join(theirs, ["part", "value"]).filter("candidate_id <> registry_id").groupBy("query_id", "candidate_id").agg(F.count("*").alias("shared"))
    if budget is not None:
        return top_per_key(shared, ["query_id"], [F.desc("shared"), F.asc("candidate_id")], max(1, budget), "candidate_rank").withColumn("candidate_rank", F.col("candidate_rank").cast("bigint"))
    return sliced_row_number(shared, ["query_id"], [-F.floor(F.col("shared") / 8)], [F.desc("shared"), F.asc("candidate_id")], "candidate_rank")


def _blocks(keypoints: DataFrame) -> DataFrame:
    """Descriptors of an image in blocks: ``idx`` and the four 64-bit words of each, flattened."""
    packed = keypoints.groupBy("image_id", F.floor(F.col("kp_idx") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("kp_idx", "d0", "d1", "d2", "d3"))).alias("k")
    )
    words = F.flatten(F.transform("k", lambda r: F.array(r["d0"], r["d1"], r["d2"], r["d3"])))
    return packed.select("image_id", "block", F.col("k.kp_idx").alias("idx"), words.alias("words"))


def descriptor_match(pairs: DataFrame, keypoints: DataFrame, ratio: float = RATIO_TEST) -> DataFrame:
    """Good matches ``(query_id, candidate_id, query_idx, train_idx, distance)`` of image pairs.

    Two nearest candidates by Hamming distance per query descriptor, ratio test, then the closest query per candidate
    descriptor; ties go to the lower index. Descriptors meet block by block: distances of two blocks are one numpy
    table inside a task, so neither all pairs of keypoints nor a whole image have to pass through one group.
    """
    blocks = _blocks(keypoints)
    left = blocks.select(F.col("image_id").alias("query_id"), F.col("block").alias("qb"), F.col("idx").alias("q_idx"),
                         F.col("words").alias("q_words"))
    right = blocks.select(F.col("image_id").alias("candidate_id"), F.col("block").alias("cb"),
                          F.col("idx").alias("c_idx"), F.col("words").alias("c_words"))
    met = pairs.select("query_id", "candidate_id").distinct().join(left, "query_id").join(right, "candidate_id")

    def nearest_two(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far = np.iinfo(np.int64).max
        for batch in batches:
            for row in batch.itertuples(index=False):
                a = np.asarray(row.q_words, dtype=np.int64).reshape(-1, 4).view(np.uint64)
                b = np.asarray(row.c_words, dtype=np.int64).reshape(-1, 4).view(np.uint64)
                dist = np.zeros((len(a), len(b)), dtype=np.int64)
                for word in range(4):
                    dist += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
                best = dist.argmin(axis=1)
                here = np.arange(len(a))
                d1 = dist[here, best]
                if len(b) > 1:
                    dist[here, best] = far
                    d2 = dist.min(axis=1)
                else:
                    d2 = np.full(len(a), far)
                yield pd.DataFrame({
                    "query_id": row.query_id, "candidate_id": row.candidate_id, "query_idx": np.asarray(row.q_idx),
                    "d1": d1, "train_idx": np.asarray(row.c_idx)[best], "d2": d2,
                })

    near = met.select("query_id", "candidate_id", "q_idx", "q_words", "c_idx", "c_words").mapInPandas(
        nearest_two, "query_id bigint, candidate_id bigint, query_idx bigint, d1 bigint, train_idx bigint, d2 bigint"
    )
    keys = ["query_id", "candidate_id", "query_idx"]
    merged = near.groupBy(*keys).agg(
        F.min(F.struct("d1", "train_idx")).alias("best"),
        F.sort_array(F.flatten(F.collect_list(F.array("d1", "d2")))).alias("ds"),
    )
    second = F.get("ds", F.lit(1))
    unset = F.lit(int(np.iinfo(np.int64).max))
    good = merged.filter((second < unset) & (F.col("best.d1") < ratio * second))
    return (
        good.groupBy("query_id", "candidate_id", F.col("best.train_idx").alias("train_idx"))
        .agg(F.min(F.struct(F.col("best.d1").alias("distance"), "query_idx")).alias("m"))
        .select("query_id", "candidate_id", F.col("m.query_idx").alias("query_idx"), "train_idx",
                F.col("m.distance").alias("distance"))
    )


def _coverage(lo_x: str, hi_x: str, lo_y: str, hi_y: str, width: Column, height: Column) -> Column:
    """Share of the frame spanned by the inliers; 0 with fewer than two of them."""
    span_x = B.clamp01((F.col(hi_x) - F.col(lo_x)) / width)
    span_y = B.clamp01((F.col(hi_y) - F.col(lo_y)) / height)
    ok = (width > 0) & (height > 0) & (F.col("inliers") >= 2)
    return F.when(ok, span_x * span_y).otherwise(0.0)


def pair_geometry_gate(pairs: DataFrame, correspondences: DataFrame, features: DataFrame) -> DataFrame:
    """Verdict per image pair from its correspondences and its fitted transform.

    ``pairs(query_id, candidate_id, h)`` with ``h`` nine doubles or null; ``correspondences(query_id, candidate_id, qx,
    qy, cx, cy, is_inlier)``; ``features(image_id, extractor, width, height, keypoint_count)``.
    """
    inl = F.col("is_inlier")
    spans = []
    for c in ("qx", "qy", "cx", "cy"):
        value = F.when(inl, F.col(c))
        spans += [F.min(value).alias(f"lo_{c}"), F.max(value).alias(f"hi_{c}")]
    sums = correspondences.groupBy("query_id", "candidate_id").agg(
        F.count("*").alias("good_matches"), F.count_if(inl).alias("inliers"), *spans
    )

    def side(prefix: str, key: str) -> DataFrame:
        return features.select(
            F.col("image_id").alias(key), F.col("extractor").alias(f"{prefix}_ex"), F.col("width").alias(f"{prefix}_w"),
            F.col("height").alias(f"{prefix}_h"), F.col("keypoint_count").alias(f"{prefix}_n"),
        )

    j = (
        pairs.join(sums, ["query_id", "candidate_id"], "left").join(side("q", "query_id"), "query_id")
        .join(side("c", "candidate_id"), "candidate_id").na.fill(0, ["good_matches", "inliers"])
    )
    h = [F.col("h")[i] for i in range(9)]
    few = F.least("q_n", "c_n")
    j = j.withColumns({
        "query_coverage": _coverage("lo_qx", "hi_qx", "lo_qy", "hi_qy", F.col("q_w"), F.col("q_h")),
        "candidate_coverage": _coverage("lo_cx", "hi_cx", "lo_cy", "hi_cy", F.col("c_w"), F.col("c_h")),
        "support": F.when(few > 0, F.col("inliers") / F.when(few > 0, few)).otherwise(0.0),
        "inlier_ratio": F.when(
            F.col("good_matches") > 0, F.col("inliers") / F.when(F.col("good_matches") > 0, F.col("good_matches"))
        ).otherwise(0.0),
        "box": B.project(h, F.col("q_w"), F.col("q_h"), F.col("c_w"), F.col("c_h")),
    })
    reason = (
        F.when(F.col("q_ex") != F.col("c_ex"), "extractor_mismatch")
        .when((F.col("q_n") == 0) | (F.col("c_n") == 0), "empty_descriptors")
        .when(F.col("good_matches") < MIN_GOOD_MATCHES, "too_few_good_matches")
        .when(F.col("h").isNull(), "homography_not_found")
        .when(F.col("inliers") < MIN_INLIERS, "insufficient_inliers")
        .when(F.col("inlier_ratio") < MIN_INLIER_RATIO, "insufficient_inlier_ratio")
        .when(F.col("support") < MIN_SUPPORT, "insufficient_keypoint_support")
        .when(F.greatest("query_coverage", "candidate_coverage") < MIN_PRIMARY_COVERAGE, "insufficient_inlier_spread")
        .when(F.least("query_coverage", "candidate_coverage") < MIN_SECONDARY_COVERAGE, "insufficient_secondary_inlier_spread")
        .when(F.col("box").isNull(), "invalid_projected_box")
        .otherwise("ok")
    )
    early = F.col("reason").isin("extractor_mismatch", "empty_descriptors", "too_few_good_matches", "homography_not_found")
    j = j.withColumn("reason", reason)
    zero = F.lit(0).cast("bigint")
    unmatched = F.col("reason").isin("extractor_mismatch", "empty_descriptors")

    def unless(cond: Column, c: str, other: Column) -> Column:
        return F.when(cond, other).otherwise(F.col(c)).alias(c)

    return j.select(
        "query_id", "candidate_id", F.col("q_ex").alias("extractor"), (F.col("reason") == "ok").alias("passed"), "reason",
        unless(unmatched, "good_matches", zero), unless(early, "inliers", zero),
        unless(early, "inlier_ratio", F.lit(0.0)), (~early).alias("homography_found"),
        unless(early, "query_coverage", F.lit(0.0)), unless(early, "candidate_coverage", F.lit(0.0)),
        unless(early, "support", F.lit(0.0)), F.when(~early, F.col("box")).alias("box"),
    )


# One flow: candidates, descriptor matching, homography, gate ---------------------------------------------------------

# Tables of sampled descriptor bits, bits of a table, and the tables' bits a candidate has to share. With 24 true matches at 50 of
# 256 differing bits some 7 keys are shared; two images of 1500 keypoints share 0.8 by chance.
TABLES, KEY_BITS, MIN_SHARED = 48, 32, 3
# Keys that are shuffled at a time (about 8 bytes each on disk), keys of a part, which one task holds; whose keypoints they are.
AT_ONCE, PART = 1 << 26, 1 << 20
MINE, THEIRS = 1, 2
# Fixed value: distance in pixels up to which a match agrees with a homography. Samples drawn for each pair.
REPROJECTION = 3.0
SAMPLES = 1000


def _sampled_keys(keypoints: DataFrame, tables: range, parts: int) -> DataFrame:
    """``(part, packed)``: the sampled bits of every descriptor in each of ``tables``, by their upper and by their lower half.

    ``keypoints(image_id, d0..d3, side)``. Bits that differ in one place at most agree in a half, and all that agree in it are
    in one of the ``parts``. ``packed`` holds many keys byte by byte: table and half, side, four bytes of bits, eight of image.
    """
    every, bits, flush = TABLES, KEY_BITS, 1 << 20

    # Local, so that it travels to the workers by value and they need not import this package.
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        places = [np.sort(rng.choice(256, bits, replace=False)) for _ in range(every)]
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            image, side, value = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            n = value.size
            table, value = np.repeat(np.array(tables, np.uint64), value.shape[1]), value.ravel()
            rows, part = np.empty((2 * n, 14), np.uint8), np.empty(2 * n, np.uint32)
            for half, same in enumerate((value >> 16, value & 0xFFFF)):
                code, at = 2 * table + np.uint64(half), slice(half * n, half * n + n)
                part[at] = ((same | code << np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)
                rows[at, 0] = code
                rows[at, 1] = np.tile(side, len(tables))
                rows[at, 2:6] = value.astype("<u4").view(np.uint8).reshape(-1, 4)
                rows[at, 6:] = np.tile(image.astype("<i8"), len(tables)).view(np.uint8).reshape(-1, 8)
            rows = rows[np.argsort(part, kind="stable")]
            names, counts = np.unique(part, return_counts=True)
            ends = np.cumsum(counts)
            return pa.RecordBatch.from_arrays([
                pa.array(names.astype(np.int32)), pa.array([rows[a:b].T.tobytes() for a, b in zip(ends - counts, ends, strict=True)], pa.binary())], ["part", "packed"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                words = np.stack([part.column(i).to_numpy() for i in range(1, 5)], axis=1)
                on = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
                value = np.stack([np.ascontiguousarray(np.packbits(on[:, places[t]], axis=1)).view(">u4")[:, 0].astype(np.uint64) for t in tables])
                held.append((part.column(0).to_numpy(), part.column(5).to_numpy(), value))
                size += 2 * value.size
                if size >= flush:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    whole = keypoints.filter("d0 is not null and d1 is not null and d2 is not null and d3 is not null")
    rows = whole.select(F.col("image_id").cast("bigint").alias("image_id"), *[F.col(d).cast("bigint").alias(d) for d in ("d0", "d1", "d2", "d3")], F.col("side").cast("int").alias("side"))
    return rows.mapInArrow(keys, "part int, packed binary")


def _meetings(packed: DataFrame) -> DataFrame:
    """``(query_id, candidate_id, bits)`` of ``packed(part, packed)``, sorted by part: bits of a candidate that a query has but for one at most.

    In a part the bits meet by their common half and one byte of the other; the byte left out decides. A row may repeat.
    """
    mine, theirs, chunk = MINE, THEIRS, 1 << 21

    def meet(tv: np.ndarray, side: np.ndarray, image: np.ndarray, byte: int) -> Iterator[tuple[np.ndarray, ...]]:
        key = tv & ~np.uint64(255 << byte)
        order = np.argsort(key)
        q, c = order[side[order] & mine > 0], order[side[order] & theirs > 0]
        begin = np.searchsorted(key[c], key[q])
        n = np.searchsorted(key[c], key[q], "right") - begin
        total, at = np.cumsum(n), 0
        while at < len(q):  # so many pairs at once
            end = max(at + 1, int(np.searchsorted(total, total[at] - n[at] + chunk, "right")))
            m = n[at:end]
            i = np.repeat(q[at:end], m)
            j = c[np.repeat(begin[at:end] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            off = np.bitwise_count(tv[i] ^ tv[j])
            ok = ((off == 1) | (off == 0) & (byte == 0)) & (image[i] != image[j])  # equal bits meet by all four bytes
            yield image[i[ok]], image[j[ok]], tv[j[ok]].view(np.int64)
            at = end

    def found(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([np.frombuffer(x, np.uint8).reshape(14, -1) for x in held], axis=1)
        value, image = (np.ascontiguousarray(rows[a:b].T).view(kind)[:, 0] for a, b, kind in ((2, 6, "<u4"), (6, 14, "<i8")))
        for half, free in ((0, (0, 8)), (1, (16, 24))):
            of = np.flatnonzero(rows[0] & 1 == half)
            tv = (rows[0, of] >> 1).astype(np.uint64) << np.uint64(32) | value[of]
            order = np.lexsort((image[of], tv))  # what repeats in an image counts once
            of, tv = of[order], tv[order]
            new = np.ones(len(of), bool)
            new[1:] = (tv[1:] != tv[:-1]) | (image[of[1:]] != image[of[:-1]])
            of, tv = of[new], tv[new]
            for byte in free:
                for q, c, b in meet(tv, rows[1, of], image[of], byte):
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(b)], ["query_id", "candidate_id", "bits"])

    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part and held:
                    yield from found(held)
                    held = []
                part = p
                held.append(x)
        if held:
            yield from found(held)

    return packed.mapInArrow(by_part, "query_id bigint, candidate_id bigint, bits bigint")


def probed_candidates(queries: DataFrame, keypoints: DataFrame, usable: DataFrame, min_shared: int = MIN_SHARED, at_once: int = AT_ONCE) -> DataFrame:
    """``(query_id, candidate_id, shared)`` by hashing of sampled descriptor bits, up to one of which may differ.

    ``queries(query_id, registry_id)`` name the images whose keypoints are looked up; candidates are the images of
    ``usable(image_id)``. A descriptor has 32 sampled bits in each table, and goes to those that agree in their upper and in
    their lower half. Pairs that share the bits of ``min_shared`` different descriptors or tables of the candidate stay; what
    repeats in an image counts once. About ``at_once`` keys are shuffled at a time, of one table at least: their pairs are
    counted and their shuffles deleted before those of the next tables.
    """
    spark = keypoints.sparkSession
    sides = queries.select(F.col("query_id").alias("image_id"), F.lit(MINE).alias("side")).union(usable.select("image_id", F.lit(THEIRS).alias("side")))
    sides = sides.groupBy("image_id").agg(F.bit_or("side").alias("side"))
    held = cut_lineage(spark, keypoints.join(sides, "image_id").select("image_id", "d0", "d1", "d2", "d3", "side"), "local_keypoints")
    keys = 2 * held.count()
    step = max(1, min(TABLES, at_once // max(1, keys)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys * step // PART))
    counts = []
    for first in range(0, TABLES, step):
        packed = _sampled_keys(held, range(first, min(TABLES, first + step)), parts)
        met = _meetings(packed.repartition(parts, "part").sortWithinPartitions("part")).repartition("query_id", "candidate_id")
        count = met.groupBy("query_id", "candidate_id").agg(F.count_distinct("bits").alias("shared"))
        counts.append(count if step == TABLES else cut_lineage(spark, count, "local_counts"))
    shared = reduce(lambda a, b: a.union(b), counts).groupBy("query_id", "candidate_id").agg(F.sum("shared").alias("shared")).filter(F.col("shared") >= min_shared)
    return shared.join(queries.select("query_id", "registry_id"), "query_id").filter("candidate_id <> registry_id").drop("registry_id")


def homographies(correspondences: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``correspondences(query_id, candidate_id, qx, qy, cx, cy)`` with ``is_inlier`` and ``h``, nine doubles or null.

    The homography of four matches drawn at random, ``samples`` times for each pair of images, that most matches agree
    with, fitted once more to all of those. Draws depend on the pair only. A pair with fewer than four matches in general
    position, or too few for the gate, has none. A group is the matches of one pair: at most the keypoints of an image.
    """
    limit, least = REPROJECTION, MIN_GOOD_MATCHES

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        def frame(p: np.ndarray) -> np.ndarray:
            scale = np.sqrt(2) / max(1e-9, np.sqrt(((p - p.mean(0)) ** 2).sum(1)).mean())
            return np.array([[scale, 0, -scale * p[:, 0].mean()], [0, scale, -scale * p[:, 1].mean()], [0, 0, 1]])

        def lift(p: np.ndarray) -> np.ndarray:
            return np.concatenate([p, np.ones((len(p), 1))], axis=1)

        def equations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            zero = np.zeros_like(a)
            top = np.concatenate([a, zero, -b[..., :1] * a], axis=-1)
            return np.concatenate([top, np.concatenate([zero, a, -b[..., 1:2] * a], axis=-1)], axis=-2)

        def agree(h: np.ndarray) -> np.ndarray:
            to = a @ np.swapaxes(h, -1, -2)
            with np.errstate(all="ignore"):
                off = np.sqrt(((to[..., :2] / to[..., 2:] - b[:, :2]) ** 2).sum(-1)) * unit
            return np.nan_to_num(off, nan=np.inf) <= limit

        out = rows.assign(is_inlier=False, h=None)
        n = len(rows)
        if n < max(4, least):
            return out
        source, target = rows[["qx", "qy"]].to_numpy(float), rows[["cx", "cy"]].to_numpy(float)
        fa, fb = frame(source), frame(target)
        a, b, unit = lift(source) @ fa.T, lift(target) @ fb.T, 1 / fb[0, 0]
        rng = np.random.default_rng([int(rows["query_id"].iloc[0]) & 0xFFFFFFFF, int(rows["candidate_id"].iloc[0]) & 0xFFFFFFFF])
        order = np.lexsort((target[:, 1], target[:, 0], source[:, 1], source[:, 0]))
        four = order[rng.random((samples, n)).argsort(axis=1)[:, :4]]
        system = equations(a[four], b[four])
        sound = np.abs(np.linalg.det(system[:, :, :8])) > 1e-9
        if not sound.any():
            return out
        drawn = np.linalg.solve(system[sound][:, :, :8], -system[sound][:, :, 8:])[:, :, 0]
        drawn = np.concatenate([drawn, np.ones((len(drawn), 1))], axis=1).reshape(-1, 3, 3)
        counts = np.concatenate([agree(part).sum(1) for part in np.array_split(drawn, -(-len(drawn) * n // 200_000))])
        best = drawn[counts.argmax()]
        inliers = agree(best)
        for _ in range(3):
            again = np.linalg.svd(equations(a[inliers], b[inliers]))[2][-1].reshape(3, 3) if inliers.sum() >= 4 else best
            now = agree(again)
            if now.sum() < inliers.sum():
                break
            best, inliers = again, now
        h = np.linalg.inv(fb) @ best @ fa
        if abs(h[2, 2]) < 1e-12:
            return out
        flat = (h / h[2, 2]).ravel().tolist()
        return rows.assign(is_inlier=inliers, h=[flat] * n)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in correspondences.schema) + ", is_inlier boolean, h array<double>"
    return correspondences.groupBy("query_id", "candidate_id").applyInPandas(fit, schema)


def local_matches(queries: DataFrame, keypoints: DataFrame, features: DataFrame, registry: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """Registry images that match each query image geometrically, from descriptors to verdict.

    ``queries(query_id, registry_id)``; ``keypoints(image_id, kp_idx, d0..d3, x, y)``; ``features(image_id, extractor, width,
    height, keypoint_count)``, one row per image; ``registry(image_id)``. Candidates by probed keys, good matches by descriptor,
    a homography for each pair and the gate. Output ``(query_id, neighbor_id, extractor, good_matches, inliers,
    inlier_ratio, homography_found, box)`` of the pairs that pass; an image is never its own neighbor.
    """
    usable = features.join(registry.select("image_id"), "image_id", "left_semi")
    pairs = probed_candidates(queries, keypoints, usable, min_shared)
    kind = features.select("image_id", "extractor")
    pairs = pairs.join(kind.select(F.col("image_id").alias("query_id"), F.col("extractor").alias("q_ex")), "query_id") \
        .join(kind.select(F.col("image_id").alias("candidate_id"), F.col("extractor").alias("c_ex")), "candidate_id").filter("q_ex = c_ex")
    pairs = cut_lineage(pairs.sparkSession, pairs.select("query_id", "candidate_id"), "local_pairs")

    def at(image: str, index: str, x: str, y: str) -> DataFrame:
        return keypoints.select(F.col("image_id").alias(image), F.col("kp_idx").alias(index), F.col("x").alias(x), F.col("y").alias(y))

    good = descriptor_match(pairs, keypoints).join(at("query_id", "query_idx", "qx", "qy"), ["query_id", "query_idx"]) \
        .join(at("candidate_id", "train_idx", "cx", "cy"), ["candidate_id", "train_idx"])
    fitted = cut_lineage(pairs.sparkSession, homographies(good.select("query_id", "candidate_id", "qx", "qy", "cx", "cy")), "local_fits")
    h = fitted.filter("h is not null").groupBy("query_id", "candidate_id").agg(F.first("h").alias("h"))
    gate = pair_geometry_gate(pairs.join(h, ["query_id", "candidate_id"], "left"), fitted, features)
    return gate.filter("passed").select("query_id", F.col("candidate_id").alias("neighbor_id"), "extractor", "good_matches", "inliers",
                                        F.round("inlier_ratio", 4).alias("inlier_ratio"), "homography_found", "box")
