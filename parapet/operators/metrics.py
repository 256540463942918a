"""Counters, histograms and rates over request logs.

Every aggregate is a sum of per-row amounts, so Spark reduces it on the map side and a
busy path or key costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from parapet.functions import histogram as H
from parapet.operators.ordered import fitting_slice, previous_value

# ---- fixed values: route templates, tile thresholds ----
ROUTE_TEMPLATES = ((r"^/api/v1/documents/[^/]+$", "/api/v1/documents/{doc_id}"),)
ERROR_FLOOR = 0.001
BANDS = {
    "request_rate": (10, 50),
    "error_ratio": (0.01, 0.05),
    "p95": (2, 5),
    "blocked": (1, 10),
}
# ---- end of fixed values ----
MICROS = 1_000_000
WIDEST_SLICE_S = 16 * 86_400  # of a series whose samples are few


def route_template(path: Column, templates: Sequence[tuple[str, str]] = ROUTE_TEMPLATES) -> Column:
    """The template of a path with parameters; any other path as it is."""
    chain = None
    for pattern, template in templates:
        chain = (F if chain is None else chain).when(path.rlike(pattern), template)
    return path if chain is None else chain.otherwise(path)


def requests_total(log: DataFrame) -> DataFrame:
    return log.groupBy(
        "method", route_template(F.col("path")).alias("path"),
        F.col("status").cast("string").alias("status"),
    ).agg(F.count("*").alias("value"))


def duration_histogram(log: DataFrame, *by: str) -> DataFrame:
    """Rows of ``by, le, value`` with cumulative counts, plus ``sum`` and ``count`` rows."""
    flags = H.bucket_flags(F.col("duration_s"))
    summed = log.groupBy(*by).agg(
        *[F.sum(flag).alias(name) for name, flag in flags.items()],
        F.count("*").alias("_count"), F.sum("duration_s").alias("_sum"),
    )
    entries = F.array(
        *[F.struct(F.lit(name).alias("le"), (F.col(f"le_{i}") if i < len(H.BOUNDS)
                                            else F.col("_count")).cast("double").alias("value"))
          for i, name in enumerate(H.BOUND_NAMES)],
        F.struct(F.lit("sum").alias("le"), F.col("_sum").alias("value")),
        F.struct(F.lit("count").alias("le"), F.col("_count").cast("double").alias("value")),
    )
    return summed.select(*by, F.explode(entries).alias("e")).select(*by, "e.le", "e.value")


def response_times(log: DataFrame) -> DataFrame:
    """Duration in milliseconds with two decimals, also as text."""
    millis = F.round(F.col("duration_s") * 1000, 2)
    return log.select(
        "request_id", millis.alias("duration_ms"),
        F.concat(millis.cast("string"), F.lit("ms")).alias("response_time"),
    )


def violations_total(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("blocked").groupBy("threat_level").agg(F.count("*").alias("value"))


def rule_triggers_total(evaluated: DataFrame, include_suspicious: bool = False) -> DataFrame:
    """Hits per rule of blocked questions; a rule named twice by a question counts twice."""
    counted = F.col("blocked")
    if include_suspicious:
        counted = counted | (F.col("threat_level") == "SUSPICIOUS")
    return (
        evaluated.where(counted).select(F.explode("triggered_rules").alias("rule"))
        .groupBy("rule").agg(F.count("*").alias("value"))
    )


def reflections_total(outputs: DataFrame) -> DataFrame:
    return outputs.agg(F.count_if("reflection_detected").alias("value"))


def rag_queries_total(evaluated: DataFrame) -> DataFrame:
    """Questions that reached retrieval."""
    return evaluated.agg(
        F.count_if(~F.col("blocked") & F.col("reject_reason").isNull()).alias("value")
    )


def samples(name: str, counter: DataFrame, *labels: str) -> DataFrame:
    """A counter table as ``metric, labels, value`` rows."""
    pairs = [part for label in labels for part in (F.lit(label), F.col(label))]
    mapped = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return counter.select(
        F.lit(name).alias("metric"), mapped.alias("labels"), F.col("value").cast("double")
    )


def histogram_samples(name: str, histogram: DataFrame, *labels: str) -> DataFrame:
    """A duration histogram as samples: ``_bucket`` with ``le``, ``_sum`` and ``_count``."""
    pairs = [part for label in labels for part in (F.lit(label), F.col(label))]
    whole = F.col("le").isin("sum", "count")
    own = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return histogram.select(
        F.concat(F.lit(f"{name}_"), F.when(whole, F.col("le")).otherwise("bucket")).alias("metric"),
        F.when(whole, own).otherwise(F.map_concat(own, F.create_map(F.lit("le"), F.col("le")))).alias("labels"),
        F.col("value").cast("double"),
    )


def label_text(labels: Column) -> Column:
    entries = F.transform(
        F.array_sort(F.map_entries(labels)),
        lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')),
    )
    return F.array_join(entries, ",")


def at_points(
    df: DataFrame,
    length_s: int,
    step_s: int,
    amounts: dict[str, Column],
    by: Sequence[str] = (),
    ts: str = "ts",
) -> DataFrame:
    """Sums over the last ``length_s`` seconds at every multiple of ``step_s``.

    A window is open on the left and closed on the right; points without rows are absent.
    Rows are first summed per step, and only these sums are copied into the windows that
    cover them.
    """
    if length_s % step_s:
        raise ValueError("the window length must be a multiple of the step")
    step = F.lit(step_s * MICROS)
    end = F.ceil(F.unix_micros(F.col(ts)) / step) * step
    per_step = df.groupBy(*by, end.alias("_end")).agg(
        *[F.sum(amount).alias(name) for name, amount in amounts.items()]
    )
    if length_s > step_s:
        offsets = F.array(*[F.lit(i * step_s * MICROS) for i in range(length_s // step_s)])
        per_step = (
            per_step.withColumn("_shift", F.explode(offsets))
            .withColumn("_end", F.col("_end") + F.col("_shift"))
            .groupBy(*by, "_end")
            .agg(*[F.sum(name).alias(name) for name in amounts])
        )
    return per_step.select(F.timestamp_micros("_end").alias("at"), *by, *amounts)


def count_amount() -> Column:
    return F.lit(1)


def error_amount() -> Column:
    return F.when(F.col("status") >= 500, 1).otherwise(0)


def request_rate(
    log: DataFrame, length_s: int = 60, step_s: int = 60, by: Sequence[str] = ()
) -> DataFrame:
    points = at_points(log, length_s, step_s, {"n": count_amount()}, by)
    return points.select("at", *by, (F.col("n") / length_s).alias("rate"))


def increase(
    log: DataFrame, length_s: int, step_s: int, by: Sequence[str] = ()
) -> DataFrame:
    return at_points(log, length_s, step_s, {"value": count_amount()}, by)


def error_ratio(log: DataFrame, length_s: int = 300, step_s: int = 60) -> DataFrame:
    """Share of 5xx; the rate below the line is at least 0.001 per second."""
    points = at_points(
        log, length_s, step_s, {"n": count_amount(), "errors": error_amount()}
    )
    rate = F.greatest(F.col("n") / length_s, F.lit(ERROR_FLOOR))
    return points.select("at", (F.col("errors") / length_s / rate).alias("error_ratio"))


def latency_points(log: DataFrame, length_s: int = 300, step_s: int = 60) -> DataFrame:
    """Cumulative bucket counts per point as the array ``counts``."""
    amounts = {"n": count_amount(), **H.bucket_flags(F.col("duration_s"))}
    points = at_points(log, length_s, step_s, amounts)
    return points.select("at", H.cumulative(F.col("n")).alias("counts"))


def latency_quantiles(log: DataFrame, length_s: int = 300, step_s: int = 60) -> DataFrame:
    counts = F.col("counts")
    return latency_points(log, length_s, step_s).select(
        "at",
        H.quantile(counts, 0.50).alias("p50"),
        H.quantile(counts, 0.95).alias("p95"),
        H.quantile(counts, 0.99).alias("p99"),
    )


def top_rules(triggers: DataFrame, k: int = 10, length_s: int = 3600, step_s: int = 3600):
    """The ``k`` rules with most hits per point; ties go by name."""
    counted = increase(triggers, length_s, step_s, ["rule"])
    order = Window.partitionBy("at").orderBy(F.desc("value"), "rule")
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).where(
        F.col("rank") <= k
    )


def band(value: Column, name: str) -> Column:
    yellow, red = BANDS[name]
    return F.when(value >= red, "red").when(value >= yellow, "yellow").otherwise("green")


def tiles(log: DataFrame, blocked: Column, length_s: int = 300, step_s: int = 300) -> DataFrame:
    """The overview figures and their colours, from one pass over the log."""
    amounts = {
        "n": count_amount(), "errors": error_amount(),
        "blocked_n": F.when(blocked, 1).otherwise(0),
        **H.bucket_flags(F.col("duration_s")),
    }
    points = at_points(log, length_s, step_s, amounts).withColumn(
        "counts", H.cumulative(F.col("n"))
    )
    rate = F.col("n") / length_s
    figures = points.select(
        "at", rate.alias("request_rate"),
        (F.col("errors") / length_s / F.greatest(rate, F.lit(ERROR_FLOOR))).alias("error_ratio"),
        H.quantile(F.col("counts"), 0.95).alias("p95"),
        F.col("blocked_n").alias("blocked"),
    )
    return figures.select("*", *[band(F.col(n), n).alias(f"{n}_band") for n in BANDS])


def counter_increase(
    samples_: DataFrame, length_s: int = 3600, slice_s: int | None = None
) -> DataFrame:
    """Increase of scraped counters per series and window, with resets.

    ``samples_`` holds ``series, ts, value`` and unique ``ts`` per series. A value below the
    one before it means a reset, and counts whole. The first sample of a series adds
    nothing. Windows are not extrapolated to their edges. Samples without a time belong to
    no window and are left out.

    A series is read in time slices that pass their last value on. Their width follows the
    counted samples of the busiest series (``fitting_slice``) unless it is given; it never
    changes a result.
    """
    timed = samples_.where(F.col("ts").isNotNull())
    micros = F.unix_micros("ts")
    if slice_s is None:
        slice_us = fitting_slice(
            timed.select(F.col("series").alias("key"), micros.alias("at")), WIDEST_SLICE_S * MICROS)
    else:
        slice_us = slice_s * MICROS
    sliced = timed.withColumn("_slice", F.floor(micros / F.lit(slice_us)))
    stepped = previous_value(sliced, ["series"], "_slice", ["ts"], "value", "_before")
    gain = (
        F.when(F.col("_before").isNull(), 0)
        .when(F.col("value") < F.col("_before"), F.col("value"))
        .otherwise(F.col("value") - F.col("_before"))
    )
    return at_points(stepped, length_s, length_s, {"increase": gain}, ["series"])
