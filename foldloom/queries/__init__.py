"""Registered queries: every operator on the whole given tables, each with SQL that computes the same."""

from __future__ import annotations

from foldloom.queries import digests, evaluation, folds, ledgers, profiles, rulesets, splits

MODULES = (profiles, folds, evaluation, rulesets, splits, digests, ledgers)


def all_queries() -> dict:
    return {name: item[0] for module in MODULES for name, item in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: item[1] for module in MODULES for name, item in module.QUERIES.items() if item[1] is not None}
