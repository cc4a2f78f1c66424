"""All queries of the engine's own operators."""

from __future__ import annotations

from . import batch, measures, pixels, rasters, reviews, rules

_ALL = pixels.QUERIES | rules.QUERIES | batch.QUERIES | rasters.QUERIES | measures.QUERIES | reviews.QUERIES


def queries() -> dict:
    return {k: v[0] for k, v in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _ALL.items() if v[1]}
