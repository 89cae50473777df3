"""Time-driven state as ordered batches and as streams: debounce, latest wins, warm periods, active time, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.operators.ordered import running, with_previous


def seconds(ts: Column) -> Column:
    """Exact microseconds of a timestamp as a whole number."""
    return F.unix_micros(ts.cast("timestamp"))


def debounce(events: DataFrame, key: str, ts: str, value: str, gap_ms: int) -> DataFrame:
    """key, fired_at, value, edits: the last edit before every quiet gap; an edit at just the gap's length starts a new burst.

    Session windows join an event at just their end, so they are a microsecond shorter than the gap. Works on batches and, after ``withWatermark``, on streams.
    """
    best = F.max_by(F.struct(F.col(ts), F.col(value)), F.struct(F.col(ts), F.col(value)))
    return events.groupBy(key, F.session_window(ts, f"{gap_ms * 1000 - 1} microseconds").alias("w")).agg(best.alias("last"), F.count("*").alias("edits")).select(key, F.col("last")[ts].alias("fired_at"), F.col("last")[value].alias("value"), "edits")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The latest row of each key by ``order``; partial maxima are taken before the shuffle, so a hot key is no burden."""
    cols = rows.columns
    best = rows.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return best.select(*[F.col("r")[c].alias(c) for c in cols])


def warm_periods(events: DataFrame, key: str, ts: str, tie: str, what: str, idle: float, pinned: Column | None = None) -> DataFrame:
    """key, loads, uses: how often what is used had to be loaded, because another was in use or it lay idle too long.

    An ``idle`` of 0 never unloads. Where the event before was ``pinned`` (by a running job), idleness doesn't count.
    """
    e = events.select(key, ts, tie, what, (F.lit(False) if pinned is None else F.coalesce(pinned, F.lit(False))).alias("__p")).withColumn("__t", seconds(F.col(ts)))
    e = with_previous(e, [key], [ts, tie], {what: "__w", "__t": "__b", "__p": "__pb"})
    late = (F.col("__t") - F.col("__b") >= int(idle * 1_000_000)) & ~F.col("__pb") & F.lit(idle > 0)
    start = F.col("__b").isNull() | ~F.col("__w").eqNullSafe(F.col(what)) | late
    return e.groupBy(key).agg(F.sum(start.cast("int")).alias("loads"), F.count("*").alias("uses"))


def active_seconds(events: DataFrame, key: str, ts: str, tie: str, is_running: Column) -> DataFrame:
    """key, active_s: the sum of the times from each event of a running state to the next event of the key."""
    e = events.select(key, ts, tie, is_running.alias("__r")).withColumn("__t", seconds(F.col(ts)))
    e = with_previous(e, [key], [ts, tie], {"__r": "__was", "__t": "__b"})
    return e.groupBy(key).agg((F.coalesce(F.sum(F.when(F.col("__was"), F.col("__t") - F.col("__b"))), F.lit(0)) / 1_000_000).alias("active_s"))


def running_load(events: DataFrame, key: str, ts: str, tie: str, change: Column, limit: int) -> DataFrame:
    """``events`` with load (the running sum of ``change`` in the key) and admitted (whether it stays within the limit)."""
    e = running(events.withColumn("__c", change.cast("bigint")), [key], [ts, tie], "__c")
    return e.withColumn("load", F.col("below") + F.col("__c")).withColumn("admitted", F.col("load") <= limit).drop("__c", "below", "total")


def transitions(events: DataFrame, key: str, ts: str, tie: str, state: str, allowed: DataFrame) -> DataFrame:
    """``events`` with before and valid: whether the step from the state before is in ``allowed`` (before, after)."""
    e = with_previous(events, [key], [ts, tie], {state: "before"})
    a = allowed.select(F.col("before").alias("b"), F.col("after").alias("a"), F.lit(True).alias("ok")).distinct()
    return e.join(a, (F.col("before") == F.col("b")) & (F.col(state) == F.col("a")), "left").withColumn("valid", F.col("before").isNull() | F.coalesce("ok", F.lit(False))).drop("a", "b", "ok")


def progress(rows: DataFrame, job: str, order: list[str], active_s: Column) -> DataFrame:
    """``rows`` with done, total, percent (at most 99 before the last row) and eta_s by the pace so far (half to even)."""
    r = running(rows.withColumn("__one", F.lit(1).cast("bigint")), [job], order, "__one").withColumn("done", F.col("below") + 1).drop("__one", "below")
    pct = F.when(F.col("done") == F.col("total"), 100).otherwise(F.least(F.lit(99), F.floor(F.col("done") * 100 / F.col("total")))).cast("int")
    return r.withColumn("percent", pct).withColumn("eta_s", F.bround(active_s * (F.col("total") - F.col("done")) / F.col("done")).cast("bigint"))


def debounce_stream(stream: DataFrame, key: str, ts: str, value: str, gap_ms: int, late: str) -> DataFrame:
    """The streaming form of ``debounce``: bursts are emitted once the watermark has passed their gap (append mode)."""
    return debounce(stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), key, ts, value, gap_ms)


def latest_stream(stream: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The streaming form of ``latest``: one row per key in update mode, replaced by every later one."""
    return stream.groupBy(key).agg(F.max_by(F.col(value), F.struct(F.col(ts), F.col(value))).alias(value), F.max(ts).alias(ts))


def ticks(rows: DataFrame, total: str, step: int = 4) -> DataFrame:
    """``rows`` with tick, percent and processed of every tick of a progress that grows by ``step`` percent up to 100 (half to even)."""
    n = -(-100 // step)
    t = rows.withColumn("tick", F.explode(F.sequence(F.lit(1), F.lit(n))))
    pct = F.least(F.lit(100), F.col("tick") * step)
    return t.withColumn("percent", pct).withColumn("processed", F.least(F.col(total).cast("bigint"), F.bround(F.col(total) * pct / 100).cast("bigint")))


def per_tick(events: DataFrame, key: str, ts: str, width: str = "1 second") -> DataFrame:
    """key, tick, done: how many events of a key came in each tick; on streams after a watermark, with a trigger of the tick's width."""
    return events.groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("done")).select(key, F.col("w.start").alias("tick"), "done")


def at_clock(rows: DataFrame, clock: Column | None = None) -> DataFrame:
    """``rows`` with made_at, the time of a report in UTC as text; ``clock`` stands in for the time of the query."""
    now = F.current_timestamp() if clock is None else clock
    return rows.withColumn("made_at", F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ssXXX").cast("string"))
