"""Exact near-duplicate join on 64-bit hashes.

A condition on Hamming distance alone plans as a Cartesian product. Here each word is turned into block keys that
two words within the distance are sure to share (``functions.hashing.block_masks``), the sides meet in an equi-join on
those keys, and the distance is the residual condition. Three points keep it exact and even:

* a pair that shares several keys is kept only under the first of them, so no distinct over pairs is needed;
* keys are as selective as ``kept`` says: of a 64-bit word cut into ``distance + kept`` blocks a key reads ``kept``, about
  21 bits at 2, 27 at 3 for 4 flips; one more suits a registry some hundred times larger. The plan is the same at all sizes;
* the join runs over distinct words and fans back out to images afterwards, so copies cost nothing inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions import hashing as H


def _first_shared(x: Column, masks: list[int]) -> Column:
    """Position of the first mask under which the XOR ``x`` vanishes."""
    out = F.when(x.bitwiseAND(F.lit(H.signed64(masks[0]))) == 0, F.lit(0))
    for i, mask in enumerate(masks[1:], start=1):
        out = out.when(x.bitwiseAND(F.lit(H.signed64(mask))) == 0, F.lit(i))
    return out


def _keyed(words: DataFrame, col: str, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.col(col).bitwiseAND(F.lit(H.signed64(m))) for m in masks])
    return words.select(col, F.posexplode(keys).alias("band", "bucket"))


def hamming_pairs(left: DataFrame, right: DataFrame, max_distance: int, kept: int = 2) -> DataFrame:
    """All pairs ``(a, b, dist)`` of ``left.a`` and ``right.b`` (distinct words) within ``max_distance`` bits."""
    masks = H.block_masks(max_distance, kept)
    lk, rk = _keyed(left.select("a"), "a", masks), _keyed(right.select("b"), "b", masks)
    diff = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.bit_count(diff) <= max_distance) & (_first_shared(diff, masks) == F.col("band"))
    met = lk.join(rk.withColumnsRenamed({"band": "band_b", "bucket": "bucket_b"}),
                  (F.col("band") == F.col("band_b")) & (F.col("bucket") == F.col("bucket_b")) & near)
    return met.select("a", "b", F.bit_count(diff).alias("dist"))


def hash_neighbors(queries: DataFrame, registry: DataFrame, phash_max: int = H.PHASH_MAX_DISTANCE,
                   whash_max: int = H.WHASH_MAX_DISTANCE, kept: int = 2) -> DataFrame:
    """For each query image every registry image close by phash or by whash, itself included.

    ``queries(query_id, phash, whash)`` x ``registry(image_id, phash, whash)`` ->
    ``(query_id, neighbor_id, phash_distance, whash_distance)``. A candidate whose phash is unusable never matches; an
    unusable whash is ignored.
    """
    q = queries.select(
        "query_id", H.decode_hash(F.col("phash")).alias("qp"), H.decode_hash(F.col("whash")).alias("qw")
    ).filter("qp is not null")
    r = registry.select(
        F.col("image_id").alias("neighbor_id"), H.decode_hash(F.col("phash")).alias("rp"),
        H.decode_hash(F.col("whash")).alias("rw"),
    ).filter("rp is not null")

    p_pairs = hamming_pairs(
        q.select(F.col("qp").alias("a")).distinct(), r.select(F.col("rp").alias("b")).distinct(),
        phash_max, kept,
    )
    w_pairs = hamming_pairs(
        q.filter("qw is not null").select(F.col("qw").alias("a")).distinct(),
        r.filter("rw is not null").select(F.col("rw").alias("b")).distinct(),
        whash_max, kept,
    )
    by_phash = (
        q.join(p_pairs, F.col("qp") == F.col("a")).join(r, F.col("rp") == F.col("b"))
        .select("query_id", "neighbor_id", F.col("dist").alias("phash_distance"),
                H.distance(F.col("qw"), F.col("rw")).alias("whash_distance"))
    )
    # Pairs already found by phash are left out by their distance, so the two branches are disjoint.
    by_whash = (
        q.join(w_pairs, F.col("qw") == F.col("a")).join(r, F.col("rw") == F.col("b"))
        .filter(H.distance(F.col("qp"), F.col("rp")) > phash_max)
        .select("query_id", "neighbor_id", H.distance(F.col("qp"), F.col("rp")).alias("phash_distance"),
                F.col("dist").alias("whash_distance"))
    )
    return by_phash.unionByName(by_whash)


def with_local_matches(hash_pairs: DataFrame, local: DataFrame) -> DataFrame:
    """Union of hash and geometric matches with the method of each pair; a query never matches itself locally.

    ``local(query_id, neighbor_id, ...evidence)``; evidence columns are null for pairs found by hash alone.
    """
    lm = local.withColumn("_local", F.lit(True))
    joined = hash_pairs.withColumn("_hash", F.lit(True)).join(lm, ["query_id", "neighbor_id"], "full")
    return joined.withColumn(
        "match_method",
        H.resolve_method(F.coalesce("_hash", F.lit(False)), F.coalesce("_local", F.lit(False))),
    ).drop("_hash", "_local")


def add_distances(pairs: DataFrame, queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach registry ids, hashes, distances and the displayed hash to match pairs.

    ``queries(query_id, registry_id, phash, whash)``; output keeps the columns of ``pairs``.
    """
    q = queries.select("query_id", "registry_id", F.col("phash").alias("query_phash"), F.col("whash").alias("query_whash"))
    r = registry.select(
        F.col("image_id").alias("neighbor_id"), F.col("phash").alias("neighbor_phash"),
        F.col("whash").alias("neighbor_whash"), F.col("created_at").alias("neighbor_created_at"),
    )
    keep = [c for c in pairs.columns if c not in ("phash_distance", "whash_distance")]
    pd_ = H.distance(H.decode_hash(F.col("query_phash")), H.decode_hash(F.col("neighbor_phash")))
    wd_ = H.distance(H.decode_hash(F.col("query_whash")), H.decode_hash(F.col("neighbor_whash")))
    base = pairs.select(*keep).join(q, "query_id").join(r, "neighbor_id")
    base = base.withColumn("phash_distance", pd_).withColumn("whash_distance", wd_)
    p, w = F.col("phash_distance"), F.col("whash_distance")
    return (
        base.withColumn("is_self_match", F.col("neighbor_id") == F.col("registry_id"))
        .withColumn("display_distance", H.display_distance(p, w))
        .withColumn("hash_display", H.hash_display(F.col("neighbor_phash"), F.col("neighbor_whash"), p, w))
    )


def sum_columns(names: list[str]) -> list[str]:
    return [f"{tier}_{m}" for tier in ("self", "same", "similar") for m in names]


def sums_from_pairs(queries: DataFrame, neighbors: DataFrame, measures: DataFrame, names: list[str]) -> DataFrame:
    """Tier sums per query from explicit match pairs; see ``neighbor_sums`` for the columns.

    ``neighbors(query_id, neighbor_id, is_self_match, has_local, phash_distance, whash_distance)``.
    """
    rows = neighbors.join(measures.withColumnRenamed("image_id", "neighbor_id").withColumn("n", F.lit(1)), "neighbor_id")
    near = H.min_distance(F.col("phash_distance"), F.col("whash_distance"))
    own = F.col("is_self_match")
    same = F.coalesce(near == 0, F.lit(False))
    tiers = {"self": own, "same": ~own & same, "similar": ~own & ~same}
    cols = [
        F.sum(F.when(cond, F.col(m)).otherwise(0)).alias(f"{tier}_{m}") for tier, cond in tiers.items() for m in [*names, "n"]
    ]
    found = [F.sum(F.when(F.col("has_local"), F.col(m)).otherwise(0)).alias(f"local_{m}") for m in [*names, "n"]]
    sums = rows.groupBy("query_id").agg(*cols, *found)
    return queries.select("query_id").join(sums, "query_id", "left").na.fill(0)


def neighbor_sums(queries: DataFrame, registry: DataFrame, measures: DataFrame, names: list[str],
                  local: DataFrame | None = None, phash_max: int = H.PHASH_MAX_DISTANCE,
                  whash_max: int = H.WHASH_MAX_DISTANCE, kept: int = 2) -> DataFrame:
    """Sums of ``measures(image_id, *names)`` over the neighbors of each query, without listing the neighbors.

    Output per query: for each measure, and for the count ``n`` of neighbors that have a row, the value of the image
    itself (``self_*``), of others at distance 0 (``same_*``) and of the rest (``similar_*``); and, among all these, of
    those that also or only matched geometrically (``local_*``).

    A wavelet hash may be shared by very many images, and then the pairs of queries and neighbors explode. So measures
    are summed per distinct whash first and only distinct words are matched. What is close by phash but not by whash
    is added image by image; a phash belongs to one registry image, so these are few. The image's own row is found in
    one of the two and moved to ``self``. Needs a registry with unique phash and ``queries(query_id, registry_id,
    phash, whash)`` whose registry row has the query's phash.
    """
    ms = [*names, "n"]
    q = queries.select(
        "query_id", "registry_id", H.decode_hash(F.col("phash")).alias("qp"), H.decode_hash(F.col("whash")).alias("qw")
    )
    carry = registry.join(measures, "image_id").select(
        "image_id", H.decode_hash(F.col("phash")).alias("rp"), H.decode_hash(F.col("whash")).alias("rw"),
        *[F.col(m).cast("bigint").alias(m) for m in names], F.lit(1).cast("bigint").alias("n"),
    ).filter("rp is not null")

    def split(cond: Column) -> list[Column]:
        return [F.sum(F.when(cond, F.col(m)).otherwise(0)).alias(f"same_{m}") for m in ms] + [
            F.sum(F.when(cond, 0).otherwise(F.col(m))).alias(f"similar_{m}") for m in ms
        ]

    tiers = [f"{t}_{m}" for t in ("same", "similar") for m in ms]
    usable = q.filter("qp is not null")
    words = usable.select("qp", "qw").distinct()

    per_whash = carry.filter("rw is not null").groupBy(F.col("rw").alias("b")).agg(*[F.sum(m).alias(m) for m in ms])
    w_pairs = hamming_pairs(words.filter("qw is not null").select(F.col("qw").alias("a")).distinct(), per_whash.select("b"),
                            whash_max, kept)
    by_whash = w_pairs.join(per_whash, "b").groupBy(F.col("a").alias("qw")).agg(*split(F.col("dist") == 0))

    p_pairs = hamming_pairs(words.select(F.col("qp").alias("a")).distinct(), carry.select(F.col("rp").alias("b")).distinct(),
                            phash_max, kept)
    far_by_whash = F.coalesce(H.distance(F.col("qw"), F.col("rw")) > whash_max, F.lit(True))
    by_phash = (
        words.join(p_pairs, F.col("qp") == F.col("a")).join(carry, F.col("rp") == F.col("b")).filter(far_by_whash)
        .groupBy("qp", "qw").agg(*split(F.col("dist") == 0))
    )
    per_word = (
        # Words without a usable whash have no sums by whash; a key of their own each keeps them apart.
        words.withColumn("wk", F.coalesce("qw", F.xxhash64("qp"))).withColumn("usable", F.col("qw").isNotNull())
        .join(by_whash.withColumnsRenamed({"qw": "b_qw", **{c: f"w_{c}" for c in tiers}}), (F.col("wk") == F.col("b_qw")) & F.col("usable"), "left")
        .join(by_phash.withColumnsRenamed({"qp": "p_qp", "qw": "p_qw", **{c: f"p_{c}" for c in tiers}}),
              (F.col("qp") == F.col("p_qp")) & F.col("qw").eqNullSafe(F.col("p_qw")), "left")
        .select("qp", "qw", *[(F.coalesce(f"w_{c}", F.lit(0)) + F.coalesce(f"p_{c}", F.lit(0))).alias(c) for c in tiers])
        .withColumnsRenamed({"qp": "x_qp", "qw": "x_qw"})
    )
    own = carry.select(F.col("image_id").alias("registry_id"), F.col("rw").alias("own_rw"), *[F.col(m).alias(f"own_{m}") for m in ms])
    j = (
        q.join(per_word, (F.col("qp") == F.col("x_qp")) & F.col("qw").eqNullSafe(F.col("x_qw")), "left")
        .join(own, "registry_id", "left")
    )
    # The image's own row counted as "similar" only when its first-seen whash is a little off the query's.
    off = F.coalesce(H.distance(F.col("qw"), F.col("own_rw")).between(1, whash_max), F.lit(False))
    matched = F.col("qp").isNotNull()
    zero = F.lit(0)

    def own_value(m: str) -> Column:
        return F.when(matched, F.coalesce(f"own_{m}", zero)).otherwise(zero)

    out = j.select(
        "query_id", *[own_value(m).alias(f"self_{m}") for m in ms],
        *[(F.coalesce(f"same_{m}", zero) - F.when(off, zero).otherwise(own_value(m))).alias(f"same_{m}") for m in ms],
        *[(F.coalesce(f"similar_{m}", zero) - F.when(off, own_value(m)).otherwise(zero)).alias(f"similar_{m}") for m in ms],
    )
    if local is None:
        return out.withColumns({f"local_{m}": zero.cast("bigint") for m in ms})
    # Geometric matches are listed pairs; only those that no hash found add to the sums.
    lm = local.select("query_id", F.col("neighbor_id").alias("image_id")).distinct().join(q, "query_id").join(carry, "image_id").filter(
        F.col("image_id") != F.col("registry_id"))
    by_hash = F.coalesce(H.distance(F.col("qp"), F.col("rp")) <= phash_max, F.lit(False)) | F.coalesce(
        H.distance(F.col("qw"), F.col("rw")) <= whash_max, F.lit(False))
    extra = lm.groupBy("query_id").agg(
        *[F.sum(F.when(by_hash, 0).otherwise(F.col(m))).alias(f"l_{m}") for m in ms], *[F.sum(m).alias(f"g_{m}") for m in ms]
    )
    out = out.join(extra, "query_id", "left")
    return out.select(
        "query_id", *sum_columns(ms)[:2 * len(ms)],
        *[(F.col(f"similar_{m}") + F.coalesce(f"l_{m}", zero)).alias(f"similar_{m}") for m in ms],
        *[F.coalesce(f"g_{m}", zero).cast("bigint").alias(f"local_{m}") for m in ms],
    )


def _totals(queries: DataFrame, registry: DataFrame, local: DataFrame | None) -> DataFrame:
    """``(query_id, n, own_n)``: how many registry images a query matches, and whether its own is among them."""
    sums = neighbor_sums(queries, registry, registry.select("image_id"), [], local)
    return sums.select("query_id", (F.col("self_n") + F.col("same_n") + F.col("similar_n")).alias("n"), F.col("self_n").alias("own_n"))


def method_counts(queries: DataFrame, registry: DataFrame, local: DataFrame, phash_max: int = H.PHASH_MAX_DISTANCE,
                  whash_max: int = H.WHASH_MAX_DISTANCE) -> DataFrame:
    """``(match_method, pairs, self_pairs)`` without listing pairs by hash.

    Pairs by hash are counted over words (``neighbor_sums``: by whash, and by phash what is far by whash). Local pairs are
    rows of ``local(query_id, neighbor_id)`` already; those that hashes find too are hybrid and come off the hash count.
    """
    q = queries.select("query_id", "registry_id", H.decode_hash(F.col("phash")).alias("qp"), H.decode_hash(F.col("whash")).alias("qw"))
    r = registry.select(F.col("image_id").alias("neighbor_id"), H.decode_hash(F.col("phash")).alias("rp"), H.decode_hash(F.col("whash")).alias("rw"))
    near = F.coalesce(H.distance(F.col("qp"), F.col("rp")) <= phash_max, F.lit(False)) | F.coalesce(
        H.distance(F.col("qw"), F.col("rw")) <= whash_max, F.lit(False))
    own = F.col("neighbor_id") == F.col("registry_id")
    listed = local.select("query_id", "neighbor_id").distinct().join(q, "query_id").join(r, "neighbor_id").agg(
        F.count_if(near).alias("hybrid"), F.count_if(near & own).alias("hybrid_self"),
        F.count_if(~near).alias("local"), F.count_if(~near & own).alias("local_self"))
    by_hash = _totals(queries, registry, None).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("own_n"), F.lit(0)).alias("own_n"))

    def row(name: str, pairs: Column, own_pairs: Column) -> Column:
        return F.struct(F.lit(name).alias("match_method"), pairs.cast("bigint").alias("pairs"), own_pairs.cast("bigint").alias("self_pairs"))

    c = F.col
    rows = F.array(row("hash", c("n") - c("hybrid"), c("own_n") - c("hybrid_self")), row("hybrid", c("hybrid"), c("hybrid_self")),
                   row("local", c("local"), c("local_self")))
    return by_hash.crossJoin(listed).select(F.explode(rows).alias("r")).select("r.*").filter("pairs > 0")  # one row each


def distant_counts(queries: DataFrame, registry: DataFrame, local: DataFrame, own: Column) -> DataFrame:
    """``(query_id, distant_match_count)``: matches of a query that are not the image itself, without listing pairs.

    ``own`` is the rule over ``(neighbor_id, is_self_match, registry_id, neighbor_phash, query_phash, neighbor_whash,
    query_whash)``; it may hold for the registry row of the query's id or phash only, which is one row, so it is asked once
    for each query. Needs a registry with unique phash.
    """
    r = registry.select(F.col("image_id").alias("neighbor_id"), F.col("phash").alias("neighbor_phash"), F.col("whash").alias("neighbor_whash"))
    self_pair = queries.select("query_id", "registry_id", F.col("phash").alias("query_phash"), F.col("whash").alias("query_whash")) \
        .join(r, F.col("registry_id") == F.col("neighbor_id")).withColumn("is_self_match", F.lit(True))
    asked = self_pair.select("query_id", F.coalesce(own, F.lit(False)).cast("int").alias("_own"))
    totals = _totals(queries, registry, local).filter("n > 0")
    return totals.join(asked, "query_id", "left").select("query_id", (F.col("n") - F.coalesce("_own", F.lit(0))).cast("bigint").alias("distant_match_count"))
