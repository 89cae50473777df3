"""Exact ranks and percentiles by a distributed sort (problem 6; also used by problem 10).

Equal values of a group are counted first, so a value that a third of all rows share is one row. The counted values are sorted
by range over all partitions; each partition's sum per group gives the offsets; so a value's position in its group is known
without gathering any group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators.ordered import running


def weighted_ranks(counted: DataFrame, groups: list[str], value: str, weight: str) -> DataFrame:
    """``counted`` with ``below`` (rows of the group with a smaller value) and ``total`` (rows of the group).

    ``counted`` has one row for each group and value. Group columns may be null (a group of its own); values must not be.
    An empty table gives an empty table.
    """
    return running(counted.select(*groups, value, weight), groups, [value], weight)


def percentiles(counted: DataFrame, groups: list[str], value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """Groups, n, and for each of ``shares`` the percentile that interpolates the neighbouring order statistics, exactly.

    Counted values of separate days or files are combined by adding their counts: the outcome is that of all rows together.
    """
    ranked = weighted_ranks(counted, groups, value, weight)
    out, picks = [], []
    for name, p in shares.items():
        pos = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        holds = lambda x: (F.col("below") <= x) & (x < F.col("below") + F.col(weight))
        picks += [F.when(holds(low), F.col(value)).alias(f"{name}_lo"), F.when(holds(high), F.col(value)).alias(f"{name}_hi")]
        out.append(name)
    hit = ranked.select(*groups, "total", *picks)
    some = F.lit(False)
    for name in out:
        some |= F.col(f"{name}_lo").isNotNull() | F.col(f"{name}_hi").isNotNull()
    got = hit.where(some).groupBy(*groups).agg(F.max("total").alias("n"), *[F.max(f"{x}_{e}").alias(f"{x}_{e}") for x in out for e in ("lo", "hi")])
    cols = []
    for name, p in shares.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        cols.append(F.round(lo + (hi - lo) * (pos - F.floor(pos)), 6).alias(name))
    return got.select(*groups, "n", *cols)


SHARES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def durations(results: DataFrame, *more) -> DataFrame:
    """Counts of each valid duration per backend and device (and ``more`` columns).

    Null, not-a-number, infinite and negative durations are no measurements and are left out; zeros stay.
    """
    ok = F.col("duration_ms").isNotNull() & ~F.isnan("duration_ms") & (F.col("duration_ms") >= 0) & (F.col("duration_ms") < float("inf"))
    return results.where(ok).groupBy("backend", "device", *more, F.col("duration_ms").alias("value")).agg(F.count("*").alias("n"))
