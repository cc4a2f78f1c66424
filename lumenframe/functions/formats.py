"""File headers and colour naming on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import c

# Brands of the ftyp box, and the code points that name sRGB.
AVIF_BRANDS = ["avif", "avis"]
HEIF_BRANDS = ["heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1"]
HEADER_BYTES = 256
CICP_SRGB, CICP_UNSPECIFIED = (1, 13, 6), 2


def file_family(content) -> Column:
    """avif or heif by the major and compatible brands of a file's first box, an AVIF brand before any other; null for other files. The minor version is no brand."""
    b = c(content)
    size = F.conv(F.hex(F.substring(b, 1, 4)), 16, 10).cast("long")
    end = F.greatest(F.least(size, F.length(b).cast("long"), F.lit(HEADER_BYTES)), F.lit(16))
    places = F.filter(F.sequence(F.lit(17), F.lit(HEADER_BYTES - 3), F.lit(4)), lambda at: at + 3 <= end)
    brands = F.transform(F.concat(F.array(F.lit(9)), places), lambda at: F.hex(F.substr(b, at, F.lit(4))))
    has = lambda names: F.arrays_overlap(brands, F.array(*[F.lit(n.encode().hex().upper()) for n in names]))
    boxed = (F.length(b) >= 16) & (F.hex(F.substring(b, 5, 4)) == b"ftyp".hex().upper())
    return F.when(boxed, F.when(has(AVIF_BRANDS), "avif").when(has(HEIF_BRANDS), "heif"))


def animated_webp(content) -> Column:
    """Whether a RIFF WebP file's extended header has the animation flag."""
    b = c(content)
    word = lambda at: F.hex(F.substring(b, at, 4))
    extended = (word(1) == b"RIFF".hex().upper()) & (word(9) == b"WEBP".hex().upper()) & (word(13) == b"VP8X".hex().upper())
    flags = F.conv(F.hex(F.substring(b, 21, 1)), 16, 10).cast("int")
    return F.coalesce(extended & (flags.bitwiseAND(F.lit(2)) != 0), F.lit(False))


def cicp_verdict(source, primaries, transfer, matrix, full_range) -> Column:
    """pass if the code points name sRGB in full range; unmeasurable where nothing was read (null source) or a code is unspecified; else fail."""
    codes = [c(primaries), c(transfer), c(matrix)]
    srgb = (codes[0] == CICP_SRGB[0]) & (codes[1] == CICP_SRGB[1]) & (codes[2] == CICP_SRGB[2]) & c(full_range)
    vague = (codes[0] == CICP_UNSPECIFIED) | (codes[1] == CICP_UNSPECIFIED) | (codes[2] == CICP_UNSPECIFIED)
    return F.when(c(source).isNull(), "unmeasurable").when(srgb, "pass").when(vague, "unmeasurable").otherwise("fail")
