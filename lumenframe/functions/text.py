"""Parsing and formatting on columns. What can't be read is null, so callers decide how to refuse it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_size(s: Column) -> Column:
    """`WxH` or `N`: struct<w,h>; zero is refused."""
    w = F.regexp_extract(s, r"^([0-9]{1,9})(?:[xX]([0-9]{1,9}))?$", 1).try_cast("int")
    h = F.regexp_extract(s, r"^([0-9]{1,9})(?:[xX]([0-9]{1,9}))?$", 2).try_cast("int")
    both = F.coalesce(h, w)
    return F.when((w > 0) & (both > 0), F.struct(w.alias("w"), both.alias("h")))


def parse_hex_color(s: Column) -> Column:
    """`#rgb`, `rgb`, `#rrggbb` or `rrggbb`: array of three ints."""
    d = F.regexp_replace(s, "^#", "")
    full = F.when(d.rlike("^[0-9A-Fa-f]{6}$"), d).when(d.rlike("^[0-9A-Fa-f]{3}$"), F.regexp_replace(d, "(.)", "$1$1"))
    return F.when(full.isNotNull(), F.array(*[F.conv(F.substring(full, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]))


def parse_max_bytes(s: Column) -> Column:
    """An integer with an optional unit: b, k or kb, m or mb (thousands), kib, mib."""
    n = F.regexp_extract(s, r"^([0-9]{1,18})\s*([A-Za-z]*)$", 1).try_cast("long")
    unit = F.lower(F.regexp_extract(s, r"^([0-9]{1,18})\s*([A-Za-z]*)$", 2))
    times = F.when(unit.isin("", "b"), 1).when(unit.isin("k", "kb"), 1_000).when(unit.isin("m", "mb"), 1_000_000).when(unit == "kib", 1_024).when(unit == "mib", 1_048_576).cast("long")
    return F.when(n > 0, F.try_multiply(n, times))


def parse_numbers(s: Column, n: int) -> Column:
    """n comma-separated numbers, or null."""
    parts = F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(parts) == n) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x)), parts)


def parse_bbox(s: Column) -> Column:
    b = parse_numbers(s, 4)
    return F.when(F.forall(b, lambda x: x >= 0) & (b[0] < b[2]) & (b[1] < b[3]), b)


def parse_pairs(s: Column) -> Column:
    """`k=v,k=v` as a map, or null where a pair has no `=`, an empty key or a repeated key."""
    parts = F.split(s, ",")
    keys = F.transform(parts, lambda x: F.trim(F.split(x, "=")[0]))
    ok = F.forall(parts, lambda x: x.rlike("^\\s*[^=\\s][^=]*=.*$")) & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(ok, F.map_from_arrays(keys, F.transform(parts, lambda x: F.trim(F.regexp_extract(x, "=(.*)$", 1)))))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def render_name(template: Column, values: dict[str, Column]) -> Column:
    out = template
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def valid_template(template: Column, names=("stem", "index", "width", "height", "ext", "role")) -> Column:
    """Only known placeholders, all closed, and a result that is one path component."""
    left = F.regexp_replace(template, r"\{(?:" + "|".join(names) + r")\}", "")
    return ~left.rlike(r"[{}/\\]") & (F.length(template) > 0)


def xml_escape(s: Column) -> Column:
    out = F.replace(s, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def human_bytes(n: Column) -> Column:
    """Bytes, KB or MB of 1024, with one decimal; ties go to the even digit."""
    tenth = lambda unit: F.format_string("%.1f", F.bround(n / F.lit(unit), 1))
    return F.when(n >= 1 << 20, F.concat(tenth(float(1 << 20)), F.lit(" MB"))).when(n >= 1 << 10, F.concat(tenth(float(1 << 10)), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def closest(key: Column, allowed: list[str]) -> Column:
    """The first of the allowed keys with the smallest edit distance, 2 at most."""
    scored = F.array(*[F.struct(F.levenshtein(key, F.lit(a)).alias("d"), F.lit(i).alias("i"), F.lit(a).alias("key")) for i, a in enumerate(allowed)])
    best = F.array_min(scored)
    return F.when(best["d"] <= 2, best["key"])
