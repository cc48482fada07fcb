"""64-bit perceptual-hash columns: decoding, distance, block keys and what is shown for a neighbor."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Match thresholds in bits and the labels shown for match methods.
PHASH_MAX_DISTANCE = 4
WHASH_MAX_DISTANCE = 3
MATCH_METHOD_LABELS = {
    "hybrid": "Hybrid (hash + local)",
    "local": "Local geometric",
    "hash": "Hash",
}


def decode_hash(hex_col: Column) -> Column:
    """16 hex digits to a signed 64-bit integer; anything else, or null, to null."""
    upper = F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("bigint")
    lower = F.conv(F.substring(hex_col, 9, 8), 16, 10).cast("bigint")
    return F.when(hex_col.rlike("^[0-9a-fA-F]{16}$"), F.shiftleft(upper, 32).bitwiseOR(lower))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two 64-bit integers, null if either is null."""
    return F.bit_count(a.bitwiseXOR(b))


def signed64(value: int) -> int:
    """An unsigned 64-bit pattern as the signed integer Spark stores."""
    return value - (1 << 64) if value >= 1 << 63 else value


def split_bits(bits: list[int], blocks: int) -> list[list[int]]:
    """Cut a list of bit positions into ``blocks`` runs whose lengths differ by at most one."""
    size, extra = divmod(len(bits), blocks)
    runs, start = [], 0
    for i in range(blocks):
        end = start + size + (1 if i < extra else 0)
        runs.append(bits[start:end])
        start = end
    return runs


def block_masks(max_distance: int, kept: int, bits: list[int] | None = None) -> list[int]:
    """Bit masks such that two words within ``max_distance`` agree under at least one of them.

    The bits are cut into ``max_distance + kept`` blocks. ``max_distance`` flipped bits touch at most that many
    blocks, so ``kept`` blocks stay untouched; one mask per choice of ``kept`` blocks therefore misses nothing.
    A larger ``kept`` gives longer, more selective keys for more keys per word.
    """
    bits = list(range(64)) if bits is None else bits
    runs = split_bits(bits, min(max_distance + kept, len(bits)))
    kept = len(runs) - max_distance
    return [sum(1 << bit for run in chosen for bit in run) for chosen in combinations(runs, kept)]


def resolve_method(hash_matched: Column, local_matched: Column) -> Column:
    """``hybrid`` when both kinds matched, ``local`` for geometry alone, else ``hash``."""
    return (
        F.when(hash_matched & local_matched, "hybrid").when(local_matched, "local").otherwise("hash")
    )


def method_label(method: Column) -> Column:
    """Display label of a match method; unknown or missing methods read as hash matches."""
    key = F.lower(F.coalesce(F.nullif(method, F.lit("")), F.lit("hash")))
    label = F.when(key == "hash", MATCH_METHOD_LABELS["hash"])
    for name in ("hybrid", "local"):
        label = label.when(key == name, MATCH_METHOD_LABELS[name])
    return label.otherwise(MATCH_METHOD_LABELS["hash"])


def whash_shown(phash_dist: Column, whash_dist: Column) -> Column:
    """Whether the wavelet hash is the one to show: it is known and at least as close."""
    return whash_dist.isNotNull() & (phash_dist.isNull() | (whash_dist <= phash_dist))


def display_distance(phash_dist: Column, whash_dist: Column) -> Column:
    return F.when(whash_shown(phash_dist, whash_dist), whash_dist).otherwise(F.coalesce(phash_dist, F.lit(0)))


def display_label(phash_dist: Column, whash_dist: Column) -> Column:
    return F.when(whash_shown(phash_dist, whash_dist), F.lit("whash")).otherwise(F.lit("phash"))


def hash_display(phash: Column, whash: Column, phash_dist: Column, whash_dist: Column) -> Column:
    """``"<hash> (<label>)"`` of the hash to show, or the neighbor's phash when there is none."""
    shown = F.when(whash_shown(phash_dist, whash_dist), whash).otherwise(phash)
    text = F.concat(shown, F.lit(" ("), display_label(phash_dist, whash_dist), F.lit(")"))
    return F.when(F.coalesce(shown, F.lit("")) != "", text).otherwise(phash)


def min_distance(phash_dist: Column, whash_dist: Column) -> Column:
    """Smaller of two optional distances; null only if both are."""
    return F.least(phash_dist, whash_dist)


def is_self_match(flag: Column, image_id: Column, registry_id: Column, phash: Column, row_phash: Column,
                  whash: Column, row_whash: Column) -> Column:
    """Explicit flag first, then id equality, then equal phash with equal or missing whash."""
    blank = F.lit("")
    same_phash = (
        (F.coalesce(row_phash, blank) != "") & (F.coalesce(phash, blank) == F.coalesce(row_phash, blank))
    )
    whash_ok = (
        (F.coalesce(whash, blank) == "")
        | (F.coalesce(row_whash, blank) == "")
        | (F.coalesce(whash, blank) == F.coalesce(row_whash, blank))
    )
    return F.coalesce(flag, image_id == registry_id, same_phash & whash_ok)


def local_evidence(extractor: Column, good: Column, inliers: Column, ratio: Column) -> Column:
    """Local-match evidence as a struct with defaults for missing parts; the ratio keeps four decimals."""
    return F.struct(
        F.coalesce(extractor, F.lit("orb")).alias("extractor"),
        F.coalesce(good, F.lit(0)).cast("bigint").alias("good_matches"),
        F.coalesce(inliers, F.lit(0)).cast("bigint").alias("inliers"),
        F.coalesce(F.round(ratio, 4), F.lit(0.0)).alias("inlier_ratio"),
    )
