"""Cumulative latency histograms and quantiles read from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parapet.functions.once import bind

# ---- fixed values: finite upper bounds in seconds; +Inf follows ----
BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
BOUND_NAMES = (*(repr(b) for b in BOUNDS), "+Inf")


def bucket_flags(duration: Column) -> dict[str, Column]:
    """One 0/1 column per finite bucket; summed they give the cumulative counts."""
    return {
        f"le_{i}": F.when(duration <= bound, 1).otherwise(0) for i, bound in enumerate(BOUNDS)
    }


def cumulative(total: Column) -> Column:
    """Array of cumulative counts from the summed flags, closed by the total."""
    return F.array(*[F.col(f"le_{i}").cast("double") for i in range(len(BOUNDS))],
                   total.cast("double"))


def quantile(counts: Column, q: float) -> Column:
    """Linear interpolation inside the first bucket that reaches rank ``q * total``.

    A rank in the +Inf bucket gives the last finite bound. Null without observations.
    """
    last = len(BOUNDS)
    bounds = F.array(*[F.lit(b) for b in BOUNDS])

    def read(cum: Column) -> Column:
        rank = F.element_at(cum, last + 1) * q
        place = F.array_position(F.transform(cum, lambda c: c >= rank), True).cast("int")

        def interpolate(p: Column) -> Column:
            lower = F.when(p > 1, F.try_element_at(bounds, p - 1)).otherwise(0.0)
            below = F.when(p > 1, F.try_element_at(cum, p - 1)).otherwise(0.0)
            upper = F.try_element_at(bounds, p)
            inside = F.try_element_at(cum, p) - below
            share = F.when(inside > 0, (rank - below) / inside).otherwise(1.0)
            return F.when(p > last, BOUNDS[-1]).otherwise(lower + (upper - lower) * share)

        return F.when(F.element_at(cum, last + 1) > 0, bind(place, interpolate))

    return bind(counts, read)
