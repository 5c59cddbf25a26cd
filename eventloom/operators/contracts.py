"""Column contracts of composed tables: schema, keys and row counts are checked while a stage is written, not by a scan after it.

A stage that joins features to a table must keep its rows: a feature table with a key twice would repeat events.  The rows of a
stage and its null keys are counted by an observation on the way into the stage's table; the key's uniqueness is checked once,
on the first stage, because a later stage with as many rows and the same keys cannot have lost it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from eventloom.session import tabled


class ContractError(ValueError):
    """A stage broke its contract."""


def columns_hold(df: DataFrame, stage: str, columns: dict[str, str]) -> None:
    """Raise where a column of ``columns`` (name to Spark type) is missing or has another type."""
    types = dict(df.dtypes)
    wrong = {n: types.get(n) for n, t in columns.items() if types.get(n) != t}
    if wrong:
        raise ContractError(f"{stage}: expected {({n: columns[n] for n in wrong})}, found {wrong}")


def unique(df: DataFrame, stage: str, keys: list[str]) -> None:
    """Raise where a key occurs twice; the counts are combined before they travel and one row reaches the driver."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").first()
    if twice:
        raise ContractError(f"{stage}: key {tuple(twice)[:-1]} occurs {twice.n} times")


def stage(df: DataFrame, name: str, columns: dict[str, str], keys: list[str], rows: int | None = None) -> tuple[DataFrame, int]:
    """``df`` as a table, and its row count.  Raises on missing or wrongly typed columns, null keys, or a count other than ``rows``.

    An empty table holds any contract on its rows.  The counts are taken in the tasks that write, so a task that is run again
    counts once."""
    columns_hold(df, name, columns)
    seen = Observation()
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    out = tabled(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(null).alias("nulls")))
    got = seen.get
    n, nulls = got.get("rows") or 0, got.get("nulls") or 0
    if nulls:
        raise ContractError(f"{name}: {nulls} rows without a key")
    if rows is not None and n != rows:
        raise ContractError(f"{name}: {n} rows, expected {rows}")
    return out, n
