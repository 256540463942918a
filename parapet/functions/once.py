"""Evaluating a costly expression once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps may test and reuse freely.

    The optimizer moves a filter below a projection by copying the tested expression into
    it. The output of a generator is not copied, so the expression runs once per row.
    """
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [F.col(name) for name in df.columns if name not in columns]
    return df.select(*kept, F.inline_outer(F.array(values)))
