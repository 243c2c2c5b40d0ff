"""Ordered folds: groupings whose state starts anew at places that the data decide.

A window sum can't express them, for the carry falls to zero at each cut. A
key's units come to one partition in order, and one pass over it keeps the state
of the current key only: the work is linear, a key of any number of units takes
no more memory than a batch, and the sort spills. Only keys, order and sizes
travel. ``ordered_fold`` takes any other rule as a function over a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running_rows(rows: DataFrame, keys: list[str], order: list[str], values: list[str], step: Callable, out: str) -> DataFrame:
    """The key, order and value columns, and the columns ``out`` of what ``step(state, *values)`` gives for every row: (new state, tuple); a key's first state is None.

    ``out`` is a schema of plain types, as "n int, ok boolean".
    """
    rows = rows.select(*keys, *order, *values).repartition(*keys).sortWithinPartitions(*keys, *order)
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    names, types = zip(*(c.split() for c in out.split(",")), strict=True)
    n_keys, first = len(keys), len(keys) + len(order)

    def run(batches):
        last, state = object(), None
        for batch in batches:
            found = []
            columns = [batch.column(i).to_pylist() for i in (*range(n_keys), *range(first, batch.num_columns))]
            for row in zip(*columns, strict=True):
                if row[:n_keys] != last:
                    last, state = row[:n_keys], None
                state, value = step(state, *row[n_keys:])
                found.append(value)
            made = [pa.array(x, kinds[t]) for x, t in zip(zip(*found, strict=True) if found else [()] * len(names), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, {out}")


def running(units: DataFrame, keys: list[str], order: list[str], size: Column, step: Callable, name: str, kind: str = "int") -> DataFrame:
    """The key and order columns, ``size`` and what ``step(state, size)`` gives for every unit: (new state, value); a key's first state is None."""

    def one(state, n):
        state, value = step(state, n)
        return state, (value,)

    return running_rows(units.select(*keys, *order, size.cast("long").alias("size")), keys, order, ["size"], one, f"{name} {kind}")


def soft_batches(units: DataFrame, keys: list[str], order: list[str], size: Column, max_size: int, max_items: int) -> DataFrame:
    """A batch closes once it is over its size or number of items; the unit that brings it there stays in it."""

    def step(state, n):
        batch, total, items = state or (0, 0, 0)
        total, items = total + n, items + 1
        return ((batch + 1, 0, 0) if total > max_size or items > max_items else (batch, total, items)), batch

    return running(units, keys, order, size, step, "batch")


def hard_batches(units: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """A batch closes before a unit that would bring it over the budget; a larger unit stands alone."""

    def step(state, n):
        if state is None:
            return (0, n), 0
        batch, total = state
        return ((batch + 1, n), batch + 1) if total + n > budget else ((batch, total + n), batch)

    return running(units, keys, order, size, step, "batch")


def coalesced_sections(sections: DataFrame, keys: list[str], order: list[str], pages: Column, least: int, most: int) -> DataFrame:
    """Sections merge while the current one is short of ``least`` pages and both together have ``most`` at most."""

    def step(state, n):
        if state is None:
            return (0, n), 0
        batch, total = state
        return ((batch, total + n), batch) if total < least and total + n <= most else ((batch + 1, n), batch + 1)

    return running(sections, keys, order, pages, step, "batch")


def anchored_duplicates(rows: DataFrame, keys: list[str], order: list[str], seconds: Column, window: int) -> DataFrame:
    """Rows with ``accepted``: no row accepted within ``window`` seconds before; what isn't accepted anchors nothing.

    ``seconds`` is a whole number of seconds or finer units alike for window.
    """

    def step(anchor, t):
        take = anchor is None or t - anchor > window
        return (t if take else anchor), take

    return running(rows, keys, order, seconds, step, "accepted", "boolean").drop("size")


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over each key's rows in order; keys have to be small enough for one task."""
    return df.groupBy(*keys).applyInPandas(lambda rows: fn(rows.sort_values(order, kind="stable").reset_index(drop=True)), schema)
