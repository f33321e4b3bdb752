"""All registered queries."""

from __future__ import annotations

import importlib

from plumbline.plans.registry import Query

GROUPS = (
    "columns", "rules", "windows", "quality", "features", "flags", "history", "series", "density", "sequences",
    "fusion", "selection", "explanation", "lineage",
)


def all_queries() -> list[Query]:
    out: list[Query] = []
    for g in GROUPS:
        out.extend(importlib.import_module(f"plumbline.plans.{g}").QUERIES)
    names = [q.name for q in out]
    if len(set(names)) != len(names):
        raise ValueError("two registered queries share a name")
    return out


def by_name() -> dict[str, Query]:
    return {q.name: q for q in all_queries()}
