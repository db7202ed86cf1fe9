"""Registered queries: operators on the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SECTIONS = ["assay", "cleaning", "joins", "stats", "ranking", "progress", "spatial", "scores", "alignments", "files"]


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for section in SECTIONS:
        importlib.import_module(f"bindloom.catalog.{section}")
