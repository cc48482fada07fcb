"""Crop containment: direct and inherited parent links, and which of them to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions import boxes as B
from provspark.session import cut_lineage


# Boxes on the way up are products in another order than step by step; a value this close below a half at the seventh
# place counts as that half.
NUDGE = 1e-10


def containment_closure(events: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Links after replaying save events ``(link_id, parent_id, child_id, box)`` in ``link_id`` order.

    Every save stores the direct link and links to all ancestors, following at each step the first link that made the
    current image a child *before* this save; the walk ends at the root, or where an image would come a second time. With
    ``max_depth`` it ends after that many links instead. Boxes are composed on the way up; ancestors contribute their
    stored six-decimal box. Output ``(parent_id, child_id, box, depth)``, one row per distinct link.

    First links are pointers, so jumps of 1, 2, 4, ... links are made by joining pointers with themselves: as many rounds
    as the longest walk has binary digits. A step maps a coordinate ``v`` to ``min(high, scale * v + shift)``, and so does
    a jump. A jump carries the greatest link id on its way and holds for saves after it. Walks that lead into a cycle of
    first links are taken level by level, as are those with a ``max_depth``, which are that many joins.
    """
    direct = events.select("link_id", "parent_id", "child_id", B.normalize(F.col("box")).alias("box")).filter(
        "box is not null"
    )
    first = (
        direct.filter("parent_id <> child_id").groupBy("child_id")
        .agg(F.min_by(F.struct("link_id", "parent_id", B.rounded(F.col("box")).alias("box")), "link_id").alias("a"))
        .select(F.col("child_id").alias("a_child"), F.col("a.link_id").alias("a_link"), F.col("a.parent_id").alias("a_parent"),
                F.col("a.box").alias("a_box"))
    )
    if max_depth is not None:
        return _links(_levels(direct, first, max_depth), B.rounded(F.col("box")))
    jumps, circling = _jumps(cut_lineage(events.sparkSession, first, "first_links"))
    walks = direct
    if circling is not None:
        walks = direct.join(circling.withColumnRenamed("image", "parent_id"), "parent_id", "left_anti")
    walks = walks.select("link_id", "child_id", F.col("parent_id").alias("at"), "box", F.lit(1).alias("depth"))
    for i in reversed(range(len(jumps))):
        walks = _jumped(walks, jumps[i], 2 ** i)
    # A walk that comes to its own child ends before it.
    back = walks.filter((F.col("at") == F.col("child_id")) & (F.col("depth") > 1)).groupBy("link_id").agg(F.min("depth").alias("end"))
    walks = walks.join(back, "link_id", "left").filter(F.col("end").isNull() | (F.col("depth") < F.col("end"))).drop("end")
    if circling is not None:
        round_ = direct.join(circling.withColumnRenamed("image", "parent_id"), "parent_id", "left_semi")
        walks = walks.unionByName(_levels(round_, first, None))
    return _links(walks, F.transform("box", lambda v: F.round(v + NUDGE, 6)))


def _links(walks: DataFrame, box: Column) -> DataFrame:
    out = walks.select(F.col("at").alias("parent_id"), "child_id", box.alias("box"), "depth").filter("parent_id <> child_id")
    return out.groupBy("parent_id", "child_id", "box").agg(F.min("depth").alias("depth"))


def _levels(direct: DataFrame, first: DataFrame, max_depth: int | None) -> DataFrame:
    """``(link_id, child_id, at, box, depth)`` of all walks, one join per level."""
    level = direct.select("link_id", "child_id", F.col("parent_id").alias("at"), "box", F.array("child_id", "parent_id").alias("seen"), F.lit(1).alias("depth"))
    out = level.drop("seen")
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        onward = level.join(first, (F.col("at") == F.col("a_child")) & (F.col("a_link") < F.col("link_id")))
        if max_depth is None:
            onward = onward.filter(~F.array_contains("seen", F.col("a_parent")))
        level = onward.select(
            "link_id", "child_id", F.col("a_parent").alias("at"), B.compose(F.col("a_box"), F.col("box")).alias("box"),
            F.array_append("seen", F.col("a_parent")).alias("seen"), F.lit(depth).alias("depth"),
        )
        if max_depth is None:
            level = cut_lineage(direct.sparkSession, level, "walks")
            if level.isEmpty():
                break
        out = out.unionByName(level.drop("seen"))
    return out


_SIDES = ("x", "y")


def _jumps(first: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Jumps of 1, 2, 4, ... links ``(image, to, latest, scale_x, shift_x, high_x, ..._y)``, and the images that lead into
    a cycle of first links, if any.

    Images that have a jump are counted in each round. If none drops out, none has an end between that jump's length
    and the next one's, so none has an end farther away either: all that are left go round.
    """
    box = F.col("a_box")
    jump = first.select(
        F.col("a_child").alias("image"), F.col("a_parent").alias("to"), F.col("a_link").alias("latest"),
        *[c for i, s in enumerate(_SIDES) for c in (box[i + 2].alias(f"scale_{s}"), box[i].alias(f"shift_{s}"), F.lit(1.0).alias(f"high_{s}"))],
    )
    jumps, left = [], first.count()
    while left:
        jumps.append(jump)
        up = jump.select(*[F.col(c).alias(f"u_{c}") for c in jump.columns])
        jump = jump.join(up, F.col("to") == F.col("u_image")).select(
            "image", F.col("u_to").alias("to"), F.greatest("latest", "u_latest").alias("latest"),
            *[c for s in _SIDES for c in (
                (F.col(f"u_scale_{s}") * F.col(f"scale_{s}")).alias(f"scale_{s}"),
                (F.col(f"u_scale_{s}") * F.col(f"shift_{s}") + F.col(f"u_shift_{s}")).alias(f"shift_{s}"),
                F.least(f"u_high_{s}", F.col(f"u_scale_{s}") * F.col(f"high_{s}") + F.col(f"u_shift_{s}")).alias(f"high_{s}"))],
        )
        jump = cut_lineage(first.sparkSession, jump, "jumps")
        before, left = left, jump.count()
        if left == before:
            circling = jump.select("image")
            return [j.join(circling, "image", "left_anti") for j in jumps], circling
    return jumps, None


def _jumped(walks: DataFrame, jump: DataFrame, links: int) -> DataFrame:
    """The walks, and those among them that go on by a jump, ``links`` further up."""
    box = F.col("box")
    met = walks.join(jump, (F.col("at") == F.col("image")) & (F.col("latest") < F.col("link_id")), "left")
    moved = F.array(
        *[F.least(f"high_{s}", F.col(f"scale_{s}") * box[i] + F.col(f"shift_{s}")) for i, s in enumerate(_SIDES)],
        *[F.col(f"scale_{s}") * box[i + 2] for i, s in enumerate(_SIDES)],
    )
    stay = F.struct("at", "box", "depth")
    go = F.when(F.col("image").isNotNull(), F.struct(F.col("to").alias("at"), moved.alias("box"), (F.col("depth") + links).alias("depth")))
    return met.select("link_id", "child_id", F.explode(F.array_compact(F.array(stay, go))).alias("w")).select("link_id", "child_id", "w.at", "w.box", "w.depth")


def containment_visible(links: DataFrame, votes: DataFrame, facts: DataFrame) -> DataFrame:
    """Links whose child has at least one vote or fact, with its counts; links without a box are left out.

    ``links(link_id, parent_id, child_id, box, created_at)``. Rows carry ``created_at`` for newest-first order.
    """
    n_facts = facts.groupBy("image_id").agg(F.count("*").alias("fact_count"))
    counts = (
        votes.join(n_facts, "image_id", "full").na.fill(0, ["vote_real", "vote_edited", "vote_ai", "fact_count"])
        .filter("vote_real + vote_edited + vote_ai > 0 or fact_count > 0").withColumnRenamed("image_id", "child_id")
    )
    return links.filter("box is not null").join(counts, "child_id")
