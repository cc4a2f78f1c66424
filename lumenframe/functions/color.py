"""Colour on columns: transfer functions, CIE Lab, differences, luminance, blending. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: D65 white and the sRGB primaries' matrix: fixed values.
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_linear(v) -> Column:
    s = c(v) / F.lit(255.0)
    return F.when(s <= 0.04045, s / F.lit(12.92)).otherwise(F.pow((s + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


def to_srgb_u8(v) -> Column:
    s = F.least(F.greatest(c(v), F.lit(0.0)), F.lit(1.0))
    return F.round(F.when(s <= 0.0031308, s * 12.92).otherwise(F.pow(s, F.lit(1 / 2.4)) * 1.055 - 0.055) * 255.0).cast("int")


def with_lab(df: DataFrame, rgb: tuple[str, str, str], prefix: str) -> DataFrame:
    """df with {prefix}_l, _a and _b. Each step is a projection of its own, so that nothing is computed twice and the generated code stays small."""
    out = df.withColumns({f"__n{i}": to_linear(x) for i, x in enumerate(rgb)})
    out = out.withColumns({f"__t{i}": (F.col("__n0") * row[0] + F.col("__n1") * row[1] + F.col("__n2") * row[2]) / F.lit(white) for i, (row, white) in enumerate(zip(TO_XYZ, WHITE))})
    out = out.withColumns({f"__f{i}": F.when(F.col(f"__t{i}") > 216 / 24389, F.cbrt(f"__t{i}")).otherwise((F.col(f"__t{i}") * (24389 / 27) + 16.0) / 116.0) for i in range(3)})
    own = {f"{prefix}_l": F.col("__f1") * 116.0 - 16.0, f"{prefix}_a": (F.col("__f0") - F.col("__f1")) * 500.0, f"{prefix}_b": (F.col("__f1") - F.col("__f2")) * 200.0}
    return out.select(*df.columns, *[v.alias(k) for k, v in own.items()])


def delta_e(p: str, q: str) -> Column:
    """CIE76 difference of two Lab prefixes."""
    return F.sqrt(sum(((F.col(f"{p}_{x}") - F.col(f"{q}_{x}")) * (F.col(f"{p}_{x}") - F.col(f"{q}_{x}")) for x in "ab"), (F.col(f"{p}_l") - F.col(f"{q}_l")) * (F.col(f"{p}_l") - F.col(f"{q}_l"))))


def luma(r, g, b) -> Column:
    return c(r) * 0.2126 + c(g) * 0.7152 + c(b) * 0.0722


def relative_luminance(r, g, b) -> Column:
    def one(v):
        s = c(v) / F.lit(255.0)
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return one(r) * 0.2126 + one(g) * 0.7152 + one(b) * 0.0722


def contrast_ratio(a, b) -> Column:
    return (F.greatest(c(a), c(b)) + 0.05) / (F.least(c(a), c(b)) + 0.05)


def smoothstep(t) -> Column:
    x = F.least(F.greatest(c(t), F.lit(0.0)), F.lit(1.0))
    return x * x * (F.lit(3.0) - x * 2.0)


def over(src: tuple[str, str, str, str], dst: tuple[str, str, str, str]) -> list[Column]:
    """Straight-alpha source-over of two pixels, given as SQL expressions r, g, b, a, in integers that truncate after each division."""
    sa, da = src[3], dst[3]
    below = f"(({da}) * (255 - ({sa})) div 255)"
    alpha = f"(({sa}) + {below})"
    mix = [F.expr(f"CAST((({s}) * ({sa}) + ({d}) * {below}) div greatest({alpha}, 1) AS INT)") for s, d in zip(src[:3], dst[:3])]
    return [*mix, F.expr(f"CAST({alpha} AS INT)")]


def flatten(src, alpha, base) -> Column:
    """A channel mixed onto an opaque base, rounded."""
    a = c(alpha) / F.lit(255.0)
    return F.round(c(src) * a + c(base) * (F.lit(1.0) - a)).cast("int")


def mix_u8(src: str, alpha: str, base: str) -> Column:
    """A channel mixed onto an opaque base in integers, rounded to the nearest; arguments are SQL expressions."""
    return F.expr(f"CAST((({src}) * ({alpha}) + ({base}) * (255 - ({alpha})) + 127) div 255 AS INT)")


def despill(obs, alpha, bg) -> Column:
    """The foreground's channel behind a partly transparent pixel; pixels with alpha under 16 or 255 stay."""
    a = c(alpha) / F.lit(255.0)
    clean = F.round((c(obs) - (F.lit(1.0) - a) * c(bg)) / a)
    return F.when((c(alpha) >= 16) & (c(alpha) < 255), F.least(F.greatest(clean, F.lit(0.0)), F.lit(255.0))).otherwise(c(obs)).cast("int")
