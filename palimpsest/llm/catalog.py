"""The registered queries of this package."""

from __future__ import annotations

from importlib import import_module

MODULES = ("toxicity", "passages", "warc", "pieces", "language", "jaccard", "exact", "neighbours", "mixing", "urls", "lines", "alignment", "turns")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"palimpsest.llm.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")
