"""Latency and throughput of attempts, and the concept score of translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attempt_metrics(attempts: DataFrame, groups: list[str], value: str, ok: Column) -> DataFrame:
    """groups, n, errors, median_ms, p95_ms (nearest rank), worst_ms of the attempts; latencies only of those that succeeded.

    Latencies that are null or not numbers count as errors. Equal values are counted before the percentile is taken.
    """
    good = F.coalesce(ok & F.col(value).isNotNull() & ~F.isnan(value), F.lit(False))
    rows = attempts.withColumn("__v", F.when(good, F.col(value)))
    return rows.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("__v").isNull()).alias("errors"),
        F.round(F.median("__v"), 6).alias("median_ms"),
        F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY __v)"), 6).alias("p95_ms"),
        F.round(F.max("__v"), 6).alias("worst_ms"),
    )


def throughput(median_ms: Column, chars: Column, words: Column) -> tuple[Column, Column]:
    """Characters and words a second; null for no time, and for words that aren't counted."""
    rate = lambda n: F.when(median_ms > 0, F.round(n * 1000 / median_ms, 3))
    return rate(chars), F.when(words > 0, rate(words))


def cold_and_warm(runs: DataFrame, groups: list[str], iteration: str, value: str, failure: str, warmup: int) -> DataFrame:
    """groups, cold_ms, warm_median_ms, warm_p95_ms, warm, errors, failures, failed of repeated runs.

    The first iteration (0) is the cold one; those after the warm-up are warm. A failed run has no time; failures are the different
    names of errors in order, failed whether there is any.
    """
    i, ok = F.col(iteration), F.col(failure).isNull() & F.col(value).isNotNull()
    warm = F.when(ok & (i > warmup), F.col(value))
    rows = runs.withColumn("__warm", warm).withColumn("__cold", F.when(ok & (i == 0), F.col(value)))
    return rows.groupBy(*groups).agg(
        F.round(F.max("__cold"), 6).alias("cold_ms"),
        F.round(F.median("__warm"), 6).alias("warm_median_ms"),
        F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY __warm)"), 6).alias("warm_p95_ms"),
        F.count("__warm").alias("warm"),
        F.count(failure).alias("errors"),
        F.array_join(F.array_sort(F.collect_set(failure)), ",").alias("failures"),
        F.coalesce(F.bool_or(F.col(failure).isNotNull()), F.lit(False)).alias("failed"),
    )


def route_label(backend: Column, reason: Column) -> Column:
    """A backend's name, marked where its route was a pivot; a dash for none."""
    return F.concat(F.coalesce(backend, F.lit("—")), F.when(F.contains(reason, F.lit("pivot")), " pivot").otherwise(""))


def concept_score(rows: DataFrame, output: str, concepts: str) -> Column:
    """How many concepts (arrays of alternatives) the output names, whatever the letter case."""
    low = F.lower(rows[output])
    return F.size(F.filter(rows[concepts], lambda alts: F.exists(alts, lambda a: F.contains(low, F.lower(a)))))


def number(value: Column) -> Column:
    """One decimal, or a dash for a missing value."""
    return F.when(value.isNull(), "—").otherwise(F.format_string("%.1f", value.cast("double")))


def markdown(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One line of a Markdown table per row; see ``markdown_head`` for what stands above."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *columns.values()), F.lit(" |")).alias("line"))


def markdown_head(columns: dict[str, bool]) -> list[str]:
    """The two lines above a Markdown table: names, and for each whether it holds numbers."""
    return ["| " + " | ".join(columns) + " |", "|" + "|".join("---:" if numeric else "---" for numeric in columns.values()) + "|"]
