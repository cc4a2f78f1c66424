"""Free rectangles of a picture's cells, in NumPy."""

from __future__ import annotations

import numpy as np

# Side of a cell, regions reported at most, share inside a reported one from which a rectangle is left out.
CELL, MAX_REGIONS, MAX_CONTAINED = 8, 8, 0.7


def edges(start: int, length: int, cell: int = CELL) -> np.ndarray:
    """Borders of cells; the last may be narrower."""
    return np.append(np.arange(start, start + length, cell), start + length)


def free_cells(taken: np.ndarray, xs: np.ndarray, ys: np.ndarray, margin: int) -> np.ndarray:
    """Cells (rows by columns) with no taken pixel in them or within the margin around."""
    h, w = taken.shape
    area = np.zeros((h + 1, w + 1), np.int64)
    area[1:, 1:] = np.cumsum(np.cumsum(taken, axis=0), axis=1)
    x0, x1 = np.maximum(xs[:-1] - margin, 0), np.minimum(xs[1:] + margin, w)
    y0, y1 = np.maximum(ys[:-1] - margin, 0), np.minimum(ys[1:] + margin, h)
    return area[np.ix_(y1, x1)] - area[np.ix_(y0, x1)] - area[np.ix_(y1, x0)] + area[np.ix_(y0, x0)] == 0


def maximal_rectangles(free: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(left, top, right, bottom) in cells, ends exclusive, of each free rectangle that no other contains.

    From each top row, rows are joined downward; the runs of columns that are free in all of them can't widen, and count if they can't grow up or down.
    """
    rows, out = len(free), []
    for top in range(rows):
        run = free[top].copy()
        for bottom in range(top + 1, rows + 1):
            if bottom > top + 1:
                run &= free[bottom - 1]
            if not run.any():
                break
            turns = np.flatnonzero(np.diff(np.concatenate(([0], run.view(np.int8), [0]))))
            for left, right in zip(turns[::2].tolist(), turns[1::2].tolist()):
                up = top > 0 and free[top - 1, left:right].all()
                down = bottom < rows and free[bottom, left:right].all()
                if not up and not down:
                    out.append((left, top, right, bottom))
    return out


def free_rectangles(taken: np.ndarray, within: tuple[int, int, int, int], margin: int, least: tuple[int, int], cell: int = CELL) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) in pixels of the maximal free rectangles of the area `within` that are at least so wide and high, the largest first, then by y, x and width."""
    x, y, w, h = within
    if w == 0 or h == 0:
        return []
    xs, ys = edges(x, w, cell), edges(y, h, cell)
    found = [(int(xs[a]), int(ys[b]), int(xs[c] - xs[a]), int(ys[d] - ys[b])) for a, b, c, d in maximal_rectangles(free_cells(taken, xs, ys, margin))]
    return sorted((r for r in found if r[2] >= least[0] and r[3] >= least[1]), key=lambda r: (-r[2] * r[3], r[1], r[0], r[2]))


def shared_area(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> int:
    return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def free_regions(rectangles: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of rectangles in order, those not mostly inside an earlier one that stays, up to the number reported."""
    kept: list[tuple[int, int, int, int]] = []
    for r in rectangles:
        if len(kept) < MAX_REGIONS and all(shared_area(k, r) < MAX_CONTAINED * r[2] * r[3] for k in kept):
            kept.append(r)
    return kept
