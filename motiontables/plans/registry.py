"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from .base import Catalog

TOPICS = ("timelines", "measures", "contracts", "documents", "records", "tracks", "shapes", "signals")


def full_catalog() -> Catalog:
    merged = Catalog.empty()
    for topic in TOPICS:
        merged.merge(import_module(f"{__package__}.{topic}").catalog)
    return merged
