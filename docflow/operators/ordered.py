"""Running sums and previous rows of ordered groups without gathering a group in one task.

Rows are sorted by range over all partitions, so a group that holds a third of all rows is spread like any other. Inside a
partition a linear pass over Arrow batches carries what is needed; one row per partition and group joins the partitions. What is
sorted is written once, by a checkpoint, and both read from it: a second sort might draw the ranges' borders elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.operators.lineage import cut


def _sorted(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """``df`` sorted by range over as many partitions as the session's shuffles have."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in [*groups, *order]]
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _changes(t: pa.Table, groups: list[str]) -> np.ndarray:
    """Whether each row but the first begins another group than the row before."""
    change = np.zeros(t.num_rows, dtype=bool)
    for g in groups:
        codes = t.column(g).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return change


def running(df: DataFrame, groups: list[str], order: list[str], weight: str) -> DataFrame:
    """``df`` with ``below`` (sum of the weights of the group's earlier rows) and ``total`` (of the whole group).

    Group columns may be null (a group of its own). Rows that are equal in ``order`` come in any order. Empty in, empty out.
    """
    ordered = _sorted(df, groups, order)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far, pid = None, 0, TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            w = t.column(weight).to_numpy().astype(np.int64)
            start = np.flatnonzero(_changes(t, groups))
            base = so_far if tuple(t.column(g)[0].as_py() for g in groups) == last else 0
            cum = np.cumsum(w) - w
            bounds = np.concatenate(([0], start, [len(w)]))
            shift = np.repeat(np.concatenate(([base], -cum[start])) if len(start) else np.array([base]), np.diff(bounds))
            before = cum + shift
            last = tuple(t.column(g)[-1].as_py() for g in groups)
            so_far = int(before[-1] + w[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int64()), pa.array(np.full(len(w), pid, np.int32))], names=[*b.schema.names, "__within", "__part"])

    marked = cut(ordered.mapInArrow(sums, _ddl(df) + ", __within bigint, __part int"))
    parts = marked.groupBy(*groups, "__part").agg(F.sum(weight).alias("__w"))  # at most partitions x groups rows, mostly one part a group
    w = Window.partitionBy(*groups)
    offsets = parts.select(*[F.col(g).alias(f"__o_{g}") for g in groups], F.col("__part").alias("__p"), F.coalesce(F.sum("__w").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"), F.sum("__w").over(w).alias("total"))
    same = F.col("__part") == F.col("__p")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__o_{g}"))
    return marked.join(offsets, same).select(*df.columns, (F.col("__offset") + F.col("__within")).alias("below"), "total")


def with_previous(df: DataFrame, groups: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """``df`` with, for each of ``columns`` (name: new name), its value in the group's row before, or null in the first."""
    ordered = cut(_sorted(df, groups, order))
    names, new = list(columns), list(columns.values())
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    need = list(dict.fromkeys([*groups, *names]))

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, pid = None, TaskContext.get().partitionId()
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            t = pa.Table.from_batches([b])
            change = _changes(t, groups)
            head = tuple(t.column(g)[0].as_py() for g in groups)
            at_edge = carry is None
            joined = carry is not None and carry[0] == head
            out = []
            for k, c in enumerate(names):
                col = t.column(c).combine_chunks()
                first = carry[1][k] if joined else pa.nulls(1, col.type)
                moved = pa.concat_arrays([first, col.slice(0, n - 1)])
                mask = change.copy()
                out.append(pc.if_else(pa.array(mask), pa.nulls(n, col.type), moved))
            carry = (tuple(t.column(g)[-1].as_py() for g in groups), [t.column(c).combine_chunks().slice(n - 1, 1) for c in names])
            edge = np.zeros(n, dtype=bool)
            edge[0] = at_edge
            yield pa.RecordBatch.from_arrays([*b.columns, *out, pa.array(edge), pa.array(np.full(n, pid, np.int32))], names=[*b.schema.names, *new, "__edge", "__part"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pid = None, TaskContext.get().partitionId()
        for b in batches:
            last = b.slice(b.num_rows - 1, 1) if b.num_rows else last
        if last is not None:
            yield pa.RecordBatch.from_arrays([*last.columns, pa.array([pid], pa.int32())], names=[*(f"__l_{c}" for c in last.schema.names), "__lp"])

    marked = ordered.mapInArrow(shift, _ddl(df) + "".join(f", `{n}` {types[c]}" for c, n in columns.items()) + ", __edge boolean, __part int")
    tails = ordered.mapInArrow(lambda it: ends(b.select(need) for b in it), ", ".join(f"`__l_{c}` {types[c]}" for c in need) + ", __lp int")
    # one row per partition: the last row of the nearest partition before that has rows
    w = Window.orderBy("__lp")
    nxt = tails.withColumn("__next", F.lead("__lp").over(w))
    hit = F.col("__edge") & (F.col("__part") == F.col("__next"))
    same = F.lit(True)
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__l_{g}"))
    j = marked.join(F.broadcast(nxt), hit, "left")  # as many rows as there are partitions
    filled = [F.when(F.col("__edge") & same, F.col(f"__l_{c}")).otherwise(F.col(n)).alias(n) for c, n in columns.items()]
    return j.select(*df.columns, *filled)
