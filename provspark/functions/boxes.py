"""Normalized crop boxes ``[left, top, width, height]`` as arrays of four doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest crop side in pixels and the quality thresholds of a crop.
MIN_CROP_PIXELS = 150
MIN_CROP_ENTROPY = 0.5
MIN_CROP_CONTRAST = 8.0


def clamp01(x: Column) -> Column:
    """``x`` kept within [0, 1]; null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def normalize(box: Column) -> Column:
    """Clamp every value to [0, 1]; null unless there are exactly four."""
    return F.when(F.size(box) == 4, F.transform(box, clamp01))


def rounded(box: Column) -> Column:
    """The stored form: six decimals."""
    return F.transform(box, lambda v: F.round(v, 6))


def compose(outer: Column, inner: Column) -> Column:
    """The inner box expressed in the coordinates of the outer box's image."""
    o = [outer[i] for i in range(4)]
    i_ = [inner[i] for i in range(4)]
    return F.array(
        clamp01(o[0] + i_[0] * o[2]), clamp01(o[1] + i_[1] * o[3]), clamp01(i_[2] * o[2]), clamp01(i_[3] * o[3])
    )


def parse_strings(left: Column, top: Column, width: Column, height: Column) -> Column:
    """Four form strings as a box, or null unless all are finite, in range and inside the image."""
    vals = [F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
            for c in (left, top, width, height)]
    ok = F.lit(True)
    for v in vals:
        ok = ok & v.isNotNull() & ~F.isnan(v) & (v >= 0.0) & (v <= 1.0)
    l, t, w, h = vals
    ok = ok & (w > 0) & (h > 0) & (l + w <= 1.0) & (t + h <= 1.0)
    return F.when(ok, F.array(*vals))


def parse_parent_id(raw: Column) -> Column:
    """A positive integer id or null."""
    value = F.when(F.trim(raw).rlike(r"^[+-]?[0-9]+$"), F.trim(raw).try_cast("bigint"))
    return F.when(value > 0, value)


def snap(box: Column, img_w: Column, img_h: Column) -> dict[str, Column]:
    """Pixel crop of a box, kept inside the image, with half-even rounding; null ``box`` when a side is too short."""
    left = F.greatest(F.lit(0), F.least(F.bround(box[0] * img_w).cast("bigint"), img_w - 1))
    top = F.greatest(F.lit(0), F.least(F.bround(box[1] * img_h).cast("bigint"), img_h - 1))
    width = F.greatest(F.lit(1), F.least(F.bround(box[2] * img_w).cast("bigint"), img_w - left))
    height = F.greatest(F.lit(1), F.least(F.bround(box[3] * img_h).cast("bigint"), img_h - top))
    ok = (img_w > 0) & (img_h > 0) & (width >= MIN_CROP_PIXELS) & (height >= MIN_CROP_PIXELS)
    return {
        "left_px": left, "top_px": top, "width_px": width, "height_px": height, "accepted": ok,
        "box": F.when(ok, F.array(left / img_w, top / img_h, width / img_w, height / img_h)),
    }


def as_struct(box: Column) -> Column:
    """Struct form for reports, null unless the box has four numbers."""
    return F.when(
        (F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull()),
        F.struct(box[0].alias("left"), box[1].alias("top"), box[2].alias("width"), box[3].alias("height")),
    )


def project(h: list[Column], src_w: Column, src_h: Column, dst_w: Column, dst_h: Column) -> Column:
    """Bounding box, in target units, of the source frame seen through a 3x3 transform; null when it is empty."""
    zero = F.lit(0.0)
    corners = [(zero, zero), (src_w, zero), (src_w, src_h), (zero, src_h)]
    xs, ys = [], []
    for x, y in corners:
        depth = h[6] * x + h[7] * y + h[8]
        xs.append(F.when(depth != 0, (h[0] * x + h[1] * y + h[2]) / depth).otherwise(zero))
        ys.append(F.when(depth != 0, (h[3] * x + h[4] * y + h[5]) / depth).otherwise(zero))
    usable = (dst_w > 0) & (dst_h > 0)
    w = F.when(usable, dst_w)
    hh = F.when(usable, dst_h)
    left, right = clamp01(F.least(*xs) / w), clamp01(F.greatest(*xs) / w)
    top, bottom = clamp01(F.least(*ys) / hh), clamp01(F.greatest(*ys) / hh)
    return F.when(usable & (right - left > 0) & (bottom - top > 0), F.array(left, top, right - left, bottom - top))
