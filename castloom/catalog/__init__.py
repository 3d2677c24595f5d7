"""Registered queries and the SQL that checks them, by family."""

from __future__ import annotations

from importlib import import_module

_FAMILIES = ("costs", "functions", "transcripts", "feeds", "plans", "results", "library", "files")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _FAMILIES:
    _family = import_module(f"castloom.catalog.{_name}")
    QUERIES.update(_family.QUERIES)
    ORACLES.update(_family.ORACLES)
