"""The queries of this subpackage and their SQL, by the names under which __spark_entry__.py registers them."""

from __future__ import annotations

from . import license_digest, line_dedup, mixing, near_dedup, packing, pii, quality_model, quality_rules, vp_search, warc

_MODULES = {
    "op1_quality_rules": quality_rules,
    "op2_mix_sources": mixing,
    "op3_near_dedup": near_dedup,
    "op4_warc": warc,
    "op5_pii": pii,
    "op6_pack": packing,
    "op7_license_digest": license_digest,
    "op8_quality_model": quality_model,
    "op9_line_dedup": line_dedup,
    "op10_vp_search": vp_search,
}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
