"""Appending and reshaping tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concatenate(target: DataFrame, *others: DataFrame) -> DataFrame:
    """*widen*: target columns first, then new ones; missing cells are typed NULLs."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, target)


def concatenate_into(target: DataFrame, source: DataFrame, listed: Sequence[str]) -> DataFrame:
    """*target* schema: the result has the target's columns and no others.

    Only columns the load lists are taken from the source; target columns it does
    not list are NULL even if the source has them.
    """
    wanted = {c.lower() for c in listed} & {c.lower() for c in source.columns}
    taken = [F.col(f"`{c}`") for c in target.columns if c.lower() in wanted]
    return target.unionByName(source.select(*taken), allowMissingColumns=True)


def append(target: DataFrame, source: DataFrame) -> DataFrame:
    """Same columns on both sides; a difference is an error."""
    missing = {c.lower() for c in target.columns} ^ {c.lower() for c in source.columns}
    if missing:
        raise ValueError(f"Columns differ: {', '.join(sorted(missing))}")
    return target.unionByName(source)


def no_concatenate(tables: dict[str, DataFrame], name: str, df: DataFrame) -> dict[str, DataFrame]:
    """U4: keep a load as its own table although an equal schema exists."""
    if name in tables:
        raise ValueError(f"Table '{name}' exists; NOCONCATENATE needs a new name.")
    return {**tables, name: df}


def drop_fields(df: DataFrame, *fields: str) -> DataFrame:
    """Drop columns. Unions built from ``df`` before keep them, since DataFrames do not change."""
    return df.drop(*fields)


def project(df: DataFrame, fields: dict[str, Column | str]) -> DataFrame:
    """``expr AS alias`` list; names with blanks or brackets are taken as they are."""
    return df.select(*[
        (F.col(f"`{value.strip('[]')}`") if isinstance(value, str) else value).alias(name)
        for name, value in fields.items()
    ])


def metric_rows(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per metric with its total; one scan for all metrics."""
    totals = df.agg(*[F.sum(F.col(f"`{m}`").cast("double")).alias(m) for m in metrics])
    return totals.unpivot([], list(metrics), "metric_name", "metric_total")


def enrichment(fact: DataFrame, dimension: DataFrame, alias: str, keys: Sequence[str]) -> list[Column]:
    """Dimension columns the fact does not have yet, named ``alias_column``, each once."""
    known = {c.lower() for c in fact.columns}
    chosen = []
    for column in dimension.columns:
        name = f"{alias}_{column}".lower()
        if column.lower() not in known and column not in keys and name not in known:
            known.add(name)
            chosen.append(F.col(f"`{column}`").alias(name))
    return chosen


def stable_columns(df: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """Columns in an order that depends on their names alone: ``first``, then the others sorted without case."""
    leading = [c for f in first for c in df.columns if c.lower() == f.lower()]
    rest = sorted((c for c in df.columns if c not in leading), key=lambda c: (c.lower(), c))
    return df.select(*[F.col(f"`{c}`") for c in [*leading, *rest]])


def stable_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A model's tables sorted by name without case, each with :func:`stable_columns`."""
    return {name: stable_columns(tables[name]) for name in sorted(tables, key=lambda n: (n.lower(), n))}
