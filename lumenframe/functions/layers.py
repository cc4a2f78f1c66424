"""Layers of a composition on columns: overflow, safe areas, display sizes. A rectangle is (x, y, width, height)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as C
from .color import c

# Compose thresholds.
SUBPIXEL, MIN_CONTRAST, MAX_OVERLAP = 1 / 64, 4.5, 0.02
MIN_DISPLAY_SIZE, FOREGROUND_COVERAGE, BACKGROUND_COVERAGE = 11.0, 0.5, 0.05


def overflow(rect: list, placed: list) -> Column:
    """How far a placed rectangle leaves its rectangle, at the worst edge; 1/64 pixel or less is none."""
    (x, y, w, h), (px, py, pw, ph) = [[c(v) for v in r] for r in (rect, placed)]
    worst = F.greatest((px + pw) - (x + w), (py + ph) - (y + h), x - px, y - py, F.lit(0.0))
    return F.when(worst <= SUBPIXEL, F.lit(0.0)).otherwise(worst)


def outside(area: list, placed: list) -> Column:
    return overflow(area, placed) > 0


def meets(a: list, b: list) -> Column:
    """Whether two half-open rectangles share area."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = [[c(v) for v in r] for r in (a, b)]
    return (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)


def aspect_mismatch(w, h, profile: dict = C.COMPOSE_PROFILE) -> Column:
    pw, ph = profile["canvas"]
    return F.abs((c(w).cast("double") / c(h).cast("double")) / F.lit(pw / ph) - 1.0) >= C.ASPECT_TOLERANCE


def safe_area(w, h, profile: dict = C.COMPOSE_PROFILE) -> list[Column]:
    """The profile's safe area on a canvas: stretched where the aspect agrees, else in the largest rectangle of the profile's aspect, centred."""
    (pw, ph), area = profile["canvas"], profile["safe_area"]
    cw, ch, other = c(w).cast("double"), c(h).cast("double"), aspect_mismatch(w, h, profile)
    sx, sy = cw / float(pw), ch / float(ph)
    s = F.least(sx, sy)
    left, top = (cw - s * float(pw)) / 2.0, (ch - s * float(ph)) / 2.0
    boxed = [left + s * area[0], top + s * area[1], s * area[2], s * area[3]]
    plain = [sx * area[0], sy * area[1], sx * area[2], sy * area[3]]
    return [F.when(other, b).otherwise(p) for b, p in zip(boxed, plain)]


def layer_warnings(over, contrast, overlap, beyond) -> Column:
    """Codes in order; a measure that is null gives none."""
    checks = [(c(over) > 0, "TEXT_OVERFLOW"), (c(contrast) < MIN_CONTRAST, "TEXT_CONTRAST_LOW"), (c(overlap) > MAX_OVERLAP, "LAYERS_OVERLAP"), (c(beyond), "OUTSIDE_SAFE_AREA")]
    return F.array_compact(F.array(*[F.when(k, code) for k, code in checks]))


def coverage_class(coverage) -> Column:
    return F.when(c(coverage) >= FOREGROUND_COVERAGE, "foreground").when(c(coverage) < BACKGROUND_COVERAGE, "background").otherwise("partial")


def display_height(w, h, width) -> Column:
    return F.greatest(F.round(c(h).cast("double") * c(width) / c(w)).cast("int"), F.lit(1))


def required_size(w, width) -> Column:
    """The font size that is still 11 pixels high in a display of that width."""
    return F.ceil(F.lit(MIN_DISPLAY_SIZE) * c(w) / c(width))


def required_stroke(w, width) -> Column:
    """The stroke that is still a pixel wide."""
    return F.ceil(c(w).cast("double") / c(width))
