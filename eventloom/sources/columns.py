"""Schema-side helpers: candidate names, missing columns, presence flags, completeness contracts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_column(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """First candidate present, exact match before case-insensitive match."""
    for name in candidates:
        if name in df.columns:
            return name
    folded = {c.lower(): c for c in df.columns}
    for name in candidates:
        if name.lower() in folded:
            return folded[name.lower()]
    if required:
        raise KeyError(f"none of {list(candidates)} in {df.columns}")
    return None


def fill_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add each column only when it is absent."""
    return df.withColumns({n: e for n, e in defaults.items() if n not in df.columns})


def presence(df: DataFrame, selected: dict[str, bool]) -> DataFrame:
    """``present_<field>`` for the selected fields (non-null and non-blank) and their conjunction."""
    fields = [f for f, on in selected.items() if on]
    types = dict(df.dtypes)
    flags = {f"present_{f}": F.col(f).isNotNull() & (F.trim(f) != "") if types[f] == "string" else F.col(f).isNotNull() for f in fields}
    flags = {n: F.coalesce(e, F.lit(False)) for n, e in flags.items()}
    out = df.withColumns(flags)
    return out.withColumn("has_all_selected_fields", reduce(lambda a, b: a & b, [F.col(n) for n in flags]))


def is_complete(df: DataFrame, columns: Sequence[str], flag: Column | None = None) -> bool:
    """Contract of a cached table: the columns exist, rows exist, and the flag holds everywhere."""
    if any(c not in df.columns for c in columns):
        return False
    ok = F.lit(True) if flag is None else F.bool_and(F.coalesce(flag, F.lit(False)))
    row = df.agg(F.count("*").alias("n"), ok.alias("ok") if flag is not None else F.lit(True).alias("ok")).first()
    return bool(row["n"] and row["ok"])
