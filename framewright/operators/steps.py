"""Steps of a record pipeline: functions of tables that change one field, or make several rows of one, run by name in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import udtf

Step = Callable[[DataFrame], DataFrame]
#: The fields of a transition that a step can be for; observation is a struct, the others are columns.
FIELDS = ("observation", "action", "reward", "done", "truncated", "info")


def on_field(field: str, change: Callable[[Column], Column]) -> Step:
    """The step that changes one field of a transition; `observation.state` is a field of the struct observation.

    Rows without the field's column raise ValueError when the step is applied.
    """
    name, _, inner = field.partition(".")
    if name not in FIELDS:
        raise ValueError(f"not a field of a transition: {field}")

    def step(rows: DataFrame) -> DataFrame:
        if name not in rows.columns:
            raise ValueError(f"the rows have no {name}")
        value = change(F.col(field))
        return rows.withColumn(name, F.col(name).withField(inner, value) if inner else value)

    return step


def where_field(field: str, keep: Callable[[Column], Column]) -> Step:
    """The step that keeps the rows whose field fulfils a condition."""
    return lambda rows: rows.where(keep(F.col(field)))


def piped(rows: DataFrame, steps: Iterable[tuple[str, Step]], until: str | None = None) -> DataFrame:
    """rows after the named steps in order, or up to and with the one named until; a repeated name raises ValueError."""
    steps = list(steps)
    if len({name for name, _ in steps}) < len(steps):
        raise ValueError("names of steps must differ")
    for name, step in steps:
        rows = rows.transform(step)
        if name == until:
            break
    return rows


def expanded(rows: DataFrame, keys: list[str], elements: Column) -> DataFrame:
    """keys, the element's number from 0, and its fields, for each element of an array of structs that a row makes; a row that
    makes none is gone."""
    return rows.select(*keys, F.posexplode(elements).alias("number", "_e")).select(*keys, F.col("number").cast("long").alias("number"), "_e.*")


def expanded_by(rows: DataFrame, columns: list[str], expand: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """As expanded(), by a user's function from a batch of rows to any number of rows, where columns can't express it."""
    return rows.select(*columns).mapInPandas(lambda batches: map(expand, batches), schema)


def expanded_along(rows: DataFrame, handler: type, schema: str, key: str = "episode_index", order: str = "frame_index") -> DataFrame:
    """The rows that a user's handler makes of each key's rows in order, keeping what it likes between them: a new one is made for
    each key, eval(row) may give rows for each of its rows, and terminate() after the last. A key's rows are never held together."""
    return udtf(handler, returnType=schema)(rows.asTable().partitionBy(key).orderBy(order))
