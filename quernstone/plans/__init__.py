"""Queries that apply the operators to the driver's tables. Each module has QUERIES and SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("activity", "merge", "points", "library", "text", "match", "games", "rules", "notation", "boards", "pictures", "repertoire")

#: Queries whose rows SQL does not give: their tests say what they must do.
UNLIKE_SQL: tuple[str, ...] = ("kmeans_assign", "split_cluster", "dense_groups", "pca_project")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__name__}.{m}").SQL.items()}
