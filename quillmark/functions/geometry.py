"""Page geometry as column expressions: unit rectangles with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = 1e-6


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def valid_rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    """All parts finite and in [0, 1], and no edge beyond 1 + 1e-6."""
    inside = lambda c: finite(c) & (c >= 0) & (c <= 1)
    return F.coalesce(inside(x) & inside(y) & inside(w) & inside(h) & (x + w <= 1 + EDGE) & (y + h <= 1 + EDGE), F.lit(False))


def clamp01(c: Column) -> Column:
    return F.when(finite(c), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))).otherwise(0.0)


def unit(c: Column) -> Column:
    """clamp01 of what is never infinite; c is written once, so nested formulas stay small."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(c, F.lit(0.0))))


def to_normalized_rect(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Pixels to a clamped unit rectangle; null where the page has no size."""
    left, top = clamp01(x / page_w), clamp01(y / page_h)
    right, bottom = clamp01((x + w) / page_w), clamp01((y + h) / page_h)
    parts = F.struct(left.alias("x"), top.alias("y"), F.greatest(F.lit(0.0), right - left).alias("width"), F.greatest(F.lit(0.0), bottom - top).alias("height"))
    return F.when((page_w > 0) & (page_h > 0), parts)


def to_pixel_rect(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    parts = F.struct((x * page_w).alias("x"), (y * page_h).alias("y"), (w * page_w).alias("width"), (h * page_h).alias("height"))
    return F.when((page_w > 0) & (page_h > 0), parts)


def union_rects(rects: Column) -> Column:
    """Smallest rectangle around an array of rectangles, clamped; null for none."""
    low = lambda f: F.array_min(F.transform(rects, f))
    high = lambda f: F.array_max(F.transform(rects, f))
    x, y = clamp01(low(lambda r: r["x"])), clamp01(low(lambda r: r["y"]))
    right, bottom = clamp01(high(lambda r: r["x"] + r["width"])), clamp01(high(lambda r: r["y"] + r["height"]))
    return F.when(F.size(rects) > 0, F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (bottom - y).alias("height")))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two (x, y, w, h); 0 if they do not meet."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    meet = w * h
    union = aw * ah + bw * bh - meet
    return F.when((w > 0) & (h > 0) & (union > 0), meet / union).otherwise(0.0)


def page_geometry(width: Column, height: Column, orientation: Column, max_dim: int) -> Column:
    """struct(width, height, scale, rotation, aspect): fitted into max_dim, never enlarged; EXIF 5-8 swap the axes."""
    swap = orientation.between(5, 8)
    w, h = F.when(swap, height).otherwise(width), F.when(swap, width).otherwise(height)
    scale = F.least(F.lit(1.0), max_dim / F.greatest(w, h))
    fit = lambda c: F.greatest(F.lit(1), F.round(c * scale).cast("int"))
    turned = F.when(orientation.isin(3, 4), 180).when(orientation.isin(5, 6), 90).when(orientation.isin(7, 8), 270).otherwise(0)
    parts = F.struct(fit(w).alias("width"), fit(h).alias("height"), scale.alias("scale"), turned.alias("rotation"), F.round(fit(w) / fit(h), 6).alias("aspect"))
    return F.when((width > 0) & (height > 0), parts)
