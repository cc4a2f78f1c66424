"""Measures of many pictures of one size at once, in NumPy. Planes are arrays (pictures, rows, columns); each result depends on its own picture only."""

from __future__ import annotations

import numpy as np

from ..catalog import ALPHA_FG, MASK_FG
from ..functions.color import TO_XYZ, WHITE

_V = np.arange(256) / 255.0
LINEAR = np.where(_V <= 0.04045, _V / 12.92, ((_V + 0.055) / 1.055) ** 2.4)


def lab(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = [LINEAR[v] for v in (r, g, b)]
    f = []
    for row, white in zip(TO_XYZ, WHITE):
        t = (n[0] * row[0] + n[1] * row[1] + n[2] * row[2]) / white
        f.append(np.where(t > 216 / 24389, np.cbrt(t), (t * (24389 / 27) + 16.0) / 116.0))
    return f[1] * 116.0 - 16.0, (f[0] - f[1]) * 500.0, (f[1] - f[2]) * 200.0


def background(rgb: list[np.ndarray], a: np.ndarray, width: int = 2) -> list[np.ndarray]:
    """Upper median of each channel over the perimeter ring: its opaque pixels where a picture has any there, else all."""
    ring = np.ones(a.shape[1:], bool)
    ring[width:-width, width:-width] = False
    on = a[:, ring] >= ALPHA_FG
    on |= ~on.any(axis=1, keepdims=True)
    middle = (on.sum(axis=1) // 2)[:, None]
    return [np.take_along_axis(np.sort(np.where(on, c[:, ring].astype(np.int16), 256), axis=1), middle, axis=1)[:, 0] for c in rgb]


def differences(rgb: list[np.ndarray], a: np.ndarray) -> np.ndarray:
    """CIE76 difference of each pixel to its picture's background."""
    own, of = lab(*rgb), lab(*background(rgb, a))
    return np.sqrt(sum((p - q[:, None, None]) ** 2 for p, q in zip(own, of)))


def mask(d: np.ndarray, a: np.ndarray, tolerance: float = 12.0) -> np.ndarray:
    return (d > tolerance) & (a >= MASK_FG)


def contour(on: np.ndarray) -> np.ndarray:
    """Foreground pixels with a background pixel among their four neighbours."""
    near = np.zeros_like(on)
    near[:, 1:] |= ~on[:, :-1]
    near[:, :-1] |= ~on[:, 1:]
    near[:, :, 1:] |= ~on[:, :, :-1]
    near[:, :, :-1] |= ~on[:, :, 1:]
    return on & near


def upper_medians(v: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The upper median of each picture's values where `on`; each picture has one at least."""
    n = len(v)
    held = np.sort(np.where(on, v, np.inf).reshape(n, -1), axis=1)
    return np.take_along_axis(held, (on.reshape(n, -1).sum(axis=1) // 2)[:, None], axis=1)[:, 0]


def first_last(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, none) of the true places along the last axis."""
    n = hit.shape[-1]
    return hit.argmax(axis=-1), n - 1 - hit[..., ::-1].argmax(axis=-1), ~hit.any(axis=-1)


def box_mean(v: np.ndarray) -> np.ndarray:
    """Box mean of radius 1, along rows and then along columns, rounded after each, with windows that shrink at the borders."""
    for axis in (2, 1):
        at = lambda a, b: (slice(None),) * axis + (slice(a, b),)  # noqa: B023, E731
        total = v.copy()
        total[at(1, None)] += v[at(None, -1)]
        total[at(None, -1)] += v[at(1, None)]
        total += 1
        v = total // 3
        for edge in (at(0, 1), at(-1, None)):
            v[edge] = total[edge] // 2
    return v


def moved(v: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Planes moved down by dy and right by dx; zero comes in."""
    out = np.zeros_like(v)
    out[:, dy:, dx:] = v[:, : v.shape[1] - dy, : v.shape[2] - dx]
    return out


def over(src: list[np.ndarray], dst: list[np.ndarray]) -> list[np.ndarray]:
    """Straight-alpha source-over of planes r, g, b, a, in integers that truncate after each division."""
    sa, da = src[3].astype(np.int32), dst[3].astype(np.int32)
    below = da * (255 - sa) // 255
    alpha = sa + below
    return [(s * sa + d * below) // np.maximum(alpha, 1) for s, d in zip(src[:3], dst[:3])] + [alpha]
