"""Running counts over keys of any size.

A plain window over a key puts all of the key's rows into one task. Here the rows of a
key are cut into slices along the order column, each slice is counted on its own, and the
slices are chained through a table that holds one row per key and slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    slice_column: str,
    order: Sequence[str],
    amount: Column,
    out: str,
) -> DataFrame:
    """Add the sum of ``amount`` over all rows of the key up to and including this one.

    ``slice_column`` must grow with ``order``. The big side is shuffled once, by key and
    slice; the window and the join below share that partitioning.
    """
    part = [*keys, slice_column]
    within = (
        Window.partitionBy(*part).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(slice_column)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        df.groupBy(*part).agg(F.sum(amount).alias("_n"))
        .select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        df.withColumn(out, F.sum(amount).over(within))
        .join(offsets, part)
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop("_before")
    )


SLICE_ROWS = 200_000  # a slice of a busy key holds about so many rows at most
SECOND_US = 1_000_000


def fitting_slice(events: DataFrame, widest_us: int, rows: int = SLICE_ROWS) -> int:
    """The widest slice, from ``widest_us`` in quarters down to a second, of which none
    holds more than ``rows`` events of one key.

    ``events`` holds ``key, at``. One aggregate tells whether the widest slice fits; if it does
    not, one more counts them per key and second and sums these for all widths at once. Only
    one count per width reaches the driver. The width never changes a result.
    """
    widths = [max(widest_us, SECOND_US)]
    while widths[-1] > SECOND_US:
        widths.append(max(widths[-1] // 4, SECOND_US))
    busiest = events.groupBy("key", F.floor(F.col("at") / widths[0])).agg(F.count("*").alias("n")).agg(F.max("n"))
    if len(widths) == 1 or (busiest.first()[0] or 0) <= rows:
        return widths[0]
    by_second = events.groupBy("key", F.floor(F.col("at") / SECOND_US).alias("second")).agg(
        F.count("*").alias("n"))
    slices = by_second.select("key", "second", "n", F.explode(F.array(*[F.lit(w) for w in widths[1:]])).alias("width"))
    counted = slices.groupBy("key", "width", F.floor(F.col("second") * SECOND_US / F.col("width"))).agg(
        F.sum("n").alias("n")).groupBy("width").agg(F.max("n").alias("n"))
    return max((r["width"] for r in counted.collect() if r["n"] <= rows), default=SECOND_US)


def timeline(events: DataFrame, slice_us: int) -> DataFrame:
    """Place probes between the arrivals of their key.

    ``events`` holds ``key, at, kind, id`` with ``at`` in microseconds and ``kind`` 0 for a
    probe before, 1 for an arrival at, and 2 for a probe after the arrivals of the same
    moment. Adds ``seen``, the arrivals up to here, and ``next_at``, the time of the first
    arrival from here on.
    """
    arrival = F.col("kind") == 1
    sliced = events.withColumn("slice", F.floor(F.col("at") / F.lit(slice_us)))
    forward = (
        Window.partitionBy("key", "slice").orderBy("at", "kind", "id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    backward = (
        Window.partitionBy("key", "slice").orderBy(F.desc("at"), F.desc("kind"), F.desc("id"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    later = (
        Window.partitionBy("key").orderBy(F.desc("slice"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    slices = (
        sliced.groupBy("key", "slice")
        .agg(F.count_if(arrival).alias("n"), F.min(F.when(arrival, F.col("at"))).alias("first_at"))
        .select(
            "key", "slice",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
            F.min("first_at").over(later).alias("later_at"),
        )
    )
    counted = sliced.select(
        "*",
        F.count_if(arrival).over(forward).alias("seen"),
        F.min(F.when(arrival, F.col("at"))).over(backward).alias("next_at"),
    )
    return counted.join(slices, ["key", "slice"]).select(
        *events.columns,
        (F.col("seen") + F.col("before")).alias("seen"),
        F.coalesce("next_at", "later_at").alias("next_at"),
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    slice_column: str,
    order: Sequence[str],
    value: str,
    out: str,
) -> DataFrame:
    """Add the value of the row before this one within the key, across slice borders."""
    part = [*keys, slice_column]
    within = Window.partitionBy(*part).orderBy(*order)
    last = (
        df.groupBy(*part)
        .agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
        .select(
            *part,
            F.lag("_last").over(Window.partitionBy(*keys).orderBy(slice_column)).alias("_carry"),
        )
    )
    row_number = F.row_number().over(within)
    return (
        df.withColumn(out, F.lag(value).over(within)).withColumn("_row", row_number)
        .join(last, part)
        .withColumn(out, F.when(F.col("_row") == 1, F.col("_carry")[value]).otherwise(F.col(out)))
        .drop("_row", "_carry")
    )
