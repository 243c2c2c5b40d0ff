"""Operators for large training-data pipelines; nothing else in the library imports them."""

from importlib import import_module

MODULES = ("maxscore", "minhash", "secrets", "spotsigs", "pieces", "suffixes", "mixing", "lengths", "substrings", "langid")


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").ORACLE_SQL
    return found
