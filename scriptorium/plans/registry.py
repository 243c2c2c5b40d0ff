"""All registered queries and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (name -> callable) and ORACLE_SQL (name -> SQL).
MODULES = ("scriptorium.plans.language", "scriptorium.plans.text", "scriptorium.plans.quality", "scriptorium.plans.cost", "scriptorium.plans.jobs", "scriptorium.plans.layout", "scriptorium.plans.glossary", "scriptorium.plans.chunks", "scriptorium.plans.logs", "scriptorium.plans.streams", "scriptorium.plans.structure", "scriptorium.plans.answers", "scriptorium.plans.typeset", "scriptorium.plans.units")


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(name).QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= import_module(name).ORACLE_SQL
    return found
