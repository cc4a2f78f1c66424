"""Plans of geometry as columns: sizes, boxes, rotations, canvases, blurs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def resize_plan(w: Column, h: Column, tw: Column, th: Column, fit: str) -> Column:
    """struct<w,h,x,y,upscaled> for contain, cover or exact; cover is cropped at the centre."""
    rw, rh = tw / w, th / h
    ratio = F.least(rw, rh) if fit == "contain" else F.greatest(rw, rh)
    size = lambda v, t: t if fit == "exact" else F.greatest(F.round(v * ratio), F.lit(1)).cast("int")
    nw, nh = size(w, tw), size(h, th)
    crop = lambda n, t: F.greatest(F.floor((n - t) / 2), F.lit(0)).cast("int") if fit == "cover" else F.lit(0)
    return F.struct(nw.alias("w"), nh.alias("h"), crop(nw, tw).alias("x"), crop(nh, th).alias("y"), ((nw > w) | (nh > h)).alias("upscaled"))


def rotate_plan(w: Column, h: Column, angle: Column) -> Column:
    """struct<turns,w,h>: quarter turns for multiples of 90, else turns is null and the size that of the bounding box."""
    a = F.pmod(angle, F.lit(360.0))
    turns = F.when(F.pmod(a, F.lit(90.0)) == 0, (a / 90).cast("int"))
    rad = F.radians(a)
    bw = F.ceil(F.round(F.abs(w * F.cos(rad)) + F.abs(h * F.sin(rad)), 9)).cast("int")
    bh = F.ceil(F.round(F.abs(w * F.sin(rad)) + F.abs(h * F.cos(rad)), 9)).cast("int")
    odd = turns % 2 == 1
    return F.struct(turns.alias("turns"), F.when(turns.isNull(), bw).when(odd, h).otherwise(w).alias("w"), F.when(turns.isNull(), bh).when(odd, w).otherwise(h).alias("h"))


def canvas_plan(w: Column, h: Column, cw: Column, ch: Column, fill: Column) -> Column:
    """struct<scale,w,h,x,y> of content fitted into its share of a canvas and centred."""
    scale = F.least(cw * fill / w, ch * fill / h)
    nw, nh = [F.greatest(F.round(v * scale), F.lit(1)).cast("int") for v in (w, h)]
    return F.struct(scale.alias("scale"), nw.alias("w"), nh.alias("h"), F.floor((cw - nw) / 2).cast("int").alias("x"), F.floor((ch - nh) / 2).cast("int").alias("y"))


def bbox_to_pixels(box: list[Column], w: Column, h: Column) -> list[Column]:
    """Floors of the minima, at least 0, and ceilings of the maxima, in bounds but never below the minima."""
    x1, y1 = [F.greatest(F.floor(v), F.lit(0)).cast("int") for v in box[:2]]
    x2, y2 = [F.greatest(F.least(F.greatest(F.ceil(v), F.lit(0)), n - 1), lo).cast("int") for v, n, lo in ((box[2], w, x1), (box[3], h, y1))]
    return [x1, y1, x2, y2]


def nearest(v: Column, old: Column, new: Column) -> Column:
    return F.least(F.greatest(F.round((v + 0.5) * new / old - 0.5), F.lit(0)), new - 1).cast("int")


def oriented(x: Column, y: Column, w: Column, h: Column, orientation: Column) -> tuple[Column, Column]:
    """Where EXIF orientation 1 to 8 puts pixel (x, y)."""
    o = orientation
    nx = F.when(o.isin(2, 3), w - 1 - x).when(o.isin(5, 8), y).when(o.isin(6, 7), h - 1 - y).otherwise(x)
    ny = F.when(o.isin(3, 4), h - 1 - y).when(o.isin(5, 6), x).when(o.isin(7, 8), w - 1 - x).otherwise(y)
    return nx, ny


def box_widths(sigma: float, n: int = 3) -> list[int]:
    """Odd widths of n box filters that come closest to a Gaussian of this sigma."""
    if sigma <= 0:
        return [1] * n
    ideal = math.sqrt(12 * sigma * sigma / n + 1)
    low = int(ideal)
    low -= low % 2 == 0
    low = max(low, 1)
    m = round((12 * sigma * sigma - n * low * low - 4 * n * low - 3 * n) / (-4 * low - 4))
    return [low if i < m else low + 2 for i in range(n)]


def catmull_rom(t: Column) -> list[Column]:
    t2, t3 = t * t, t * t * t
    return [t2 - (t3 + t) / 2, t3 * 1.5 - t2 * 2.5 + 1.0, t2 * 2.0 - t3 * 1.5 + t / 2, (t3 - t2) / 2]


def overlap_area(a: list[Column], b: list[Column]) -> Column:
    """Area that two half-open rectangles x, y, w, h share."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)).cast("long") * F.greatest(h, F.lit(0)).cast("long")
