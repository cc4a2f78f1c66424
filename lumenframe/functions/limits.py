"""Thresholds and choices that follow from a picture's size and its background, on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as C
from .color import c

# Limits of the cut.
EDGE_THRESHOLD, TEXTURE_HEADROOM = 8.0, 1.5
SHADOW_DIVISOR, SHADOW_LEAST, SHADOW_MOST, SHADOW_CHROMA = 24, 16, 64, 4.0
HALO_GAIN, SAME_AS_BACKGROUND = 2.0, 3.0
MAX_GAIN = 4.0
LAB_SCALE = 256


def core_tolerance(tolerance, p90) -> Column:
    """The strict core's tolerance: twice the border's 90th percentile, between 1 and a third of the tolerance, never above it."""
    ceiling = F.least(F.greatest(c(tolerance) / 3.0, F.lit(1.0)), c(tolerance))
    return F.when(ceiling <= 0, F.lit(0.0)).otherwise(F.least(F.greatest(c(p90) * 2.0, F.least(ceiling, F.lit(1.0))), ceiling))


def shadow_reach(w, h) -> Column:
    """Pixels that a shadow may reach into the picture."""
    part = F.floor(F.least(c(w), c(h)) / SHADOW_DIVISOR).cast("int")
    return F.least(F.greatest(part, F.lit(SHADOW_LEAST)), F.lit(SHADOW_MOST))


def edge_threshold(requested, p50, p90) -> Column:
    """The value asked for; else the default, raised where the background's own texture would reach it."""
    raised = F.round(c(p90) * TEXTURE_HEADROOM * 10.0) / 10.0
    return F.coalesce(c(requested), F.when((c(p50) >= EDGE_THRESHOLD) & (raised > EDGE_THRESHOLD), raised).otherwise(F.lit(EDGE_THRESHOLD)))


def scale_at_1000(w, h) -> Column:
    return F.greatest(F.greatest(c(w), c(h)) / 1000.0, F.lit(1.0))


def halo_gate(p90) -> Column:
    """The difference from which a reference colour counts as other than the background."""
    return F.greatest(c(p90) * HALO_GAIN, F.lit(SAME_AS_BACKGROUND))


def background_model(asked, uniformity) -> Column:
    """flat or field; auto takes flat where the border is uniform."""
    return F.when(c(asked) == "auto", F.when(c(uniformity) >= C.MIN_UNIFORMITY, "flat").otherwise("field")).otherwise(c(asked))


def colour_fails(uniformity, subject_high, subject_delta, p50) -> Column:
    """Whether colour can't tell the subject: an uneven background, and a subject that is uncertain or nearer than the background's own spread. No subject (null): no."""
    seen = F.when(c(subject_high), c(subject_delta) <= c(p50)).otherwise(F.lit(True))
    return (c(uniformity) < C.MIN_UNIFORMITY) & c(subject_high).isNotNull() & F.coalesce(seen, F.lit(False))


def out_of_range(*gains) -> Column:
    """Whether a gain is null, not finite or beyond 1/4 to 4."""
    bad = [c(g).isNull() | F.isnan(c(g)) | (c(g) < 1 / MAX_GAIN) | (c(g) > MAX_GAIN) for g in gains]
    out = bad[0]
    for b in bad[1:]:
        out = out | b
    return out


def quantised(v) -> Column:
    """A Lab component in 1/256 steps, truncated, within 16 bits."""
    return F.least(F.greatest((c(v).cast("float") * F.lit(float(LAB_SCALE))).cast("int"), F.lit(-32768)), F.lit(32767))


def quantised_delta(a: list, b: list) -> Column:
    """CIE76 difference of two quantised colours."""
    d = [(c(x) - c(y)).cast("double") for x, y in zip(a, b)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / float(LAB_SCALE)


def is_shadow(lab: list, ground: list, tolerance) -> Column:
    """Darker than the ground by the tolerance at most, with nearly the ground's chroma. Colours are quantised."""
    drop = (c(ground[0]) - c(lab[0])) / float(LAB_SCALE)
    da, db = [(c(lab[k]) - c(ground[k])) / float(LAB_SCALE) for k in (1, 2)]
    return (c(tolerance) > 0) & (drop > 0) & (drop <= c(tolerance)) & (da * da + db * db <= SHADOW_CHROMA**2)
