"""Splitting texts into bounded segments, lines, chunks and batches, and putting translated pieces together again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import MAX_SEGMENT, WS, has_letter, outer_space

SPACE = re.compile(r"\s+")
MARKS = ".!?。！？"


def bounded_pieces(text: str, limit: int) -> list[str]:
    """Pieces of ``limit`` characters at most: each ends after the last white space, or sentence mark at its very end, in the second
    half of the limit, else at the limit. Linear in the text's length: white space is found once."""
    n = len(text)
    if n <= limit:
        return [text] if text else []
    ends = np.array([m.end() for m in SPACE.finditer(text)], dtype=np.int64)
    inside = np.array([i for m in SPACE.finditer(text) for i in range(m.start() + 1, m.end())], dtype=np.int64)  # a run may be cut too
    spaces = np.sort(np.concatenate([ends, inside])) if len(inside) else ends
    out, at = [], 0
    while n - at > limit:
        stop = at + limit
        if text[stop - 1] not in MARKS:
            k = int(np.searchsorted(spaces, stop, side="right")) - 1
            if k >= 0 and spaces[k] - at >= limit // 2:
                stop = int(spaces[k])
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


def bounded(df: DataFrame, text: str, *keep: str, limit: int = MAX_SEGMENT) -> DataFrame:
    """The columns ``keep`` with seg_ord and seg_text for every bounded piece; null and empty texts have none.

    The pieces of a text put together are the text. One pass over Arrow batches, the same for texts of any length.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", parts array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = pa.array([bounded_pieces(t, limit) for t in b.column(0).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], parts], names=[*keep, "parts"])

    cut = df.where(F.length(text) > 0).select(text, *keep).mapInArrow(run, schema)
    return cut.select(*keep, F.posexplode("parts").alias("seg_ord", "seg_text"))


def translatable(df: DataFrame, text: str = "seg_text") -> DataFrame:
    return df.withColumn("translatable", has_letter(F.col(text)))


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """line_ord, kind (layout or text), lead, core, tail of every line and line separator, in order.

    Separators and blank lines are layout, kept as they are; the others' outer white space is peeled off.
    """
    items = F.filter(F.split(F.col(text), r"(?<=\n)|(?<=\r)(?!\n)|(?<![\r\n])(?=[\r\n])"), lambda x: x != "")
    at = df.select(*keep, F.posexplode(items).alias("line_ord", "item"))
    lead, core, tail = outer_space(F.col("item"))
    blank = F.length(F.regexp_replace("item", WS, "")) == 0
    return at.select(*keep, "line_ord", F.when(blank, "layout").otherwise("text").alias("kind"), F.when(blank, F.col("item")).otherwise(lead).alias("lead"), F.when(blank, "").otherwise(core).alias("core"), F.when(blank, "").otherwise(tail).alias("tail"))


def chunks(df: DataFrame, tokens: str, *keep: str, size: int) -> DataFrame:
    """chunk_ord and tokens of every slice of at most ``size`` tokens of an array; empty arrays have none."""
    n = F.size(tokens)
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.slice(F.col(tokens), i * size + 1, size))
    return df.where(n > 0).select(*keep, F.posexplode(parts).alias("chunk_ord", "tokens"))


def batches(df: DataFrame, owner: str, order: str, size: str, budget: int) -> DataFrame:
    """owner, order, batch of every item: items in order are packed greedily while a batch's sizes stay within ``budget``.

    A batch has at least one item. The packing of one owner runs as a fold over its ordered sizes.
    """
    rows = df.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("bigint").alias("n")))).alias("items"))
    zero = F.struct(F.lit(-1).alias("batch"), F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<int>").alias("out"))

    def pack(acc: Column, x: Column) -> Column:
        fits = (acc["batch"] >= 0) & (acc["sum"] + x["n"] <= budget)
        b = acc["batch"] + F.when(fits, 0).otherwise(1)
        return F.struct(b.alias("batch"), F.when(fits, acc["sum"] + x["n"]).otherwise(x["n"]).alias("sum"), F.concat(acc["out"], F.array(b)).alias("out"))

    packed = rows.select(owner, "items", F.aggregate("items", zero, pack)["out"].alias("b"))
    return packed.select(owner, F.explode(F.arrays_zip("items", "b")).alias("z")).select(owner, F.col("z.items.o").alias(order), F.col("z.b").alias("batch"))


def reassemble(parts: DataFrame, owner: str, order: str, target: Column) -> DataFrame:
    """owner, text: translated lines and layout in order, with a separator between neighbours that have no white space between.

    ``parts`` are rows of ``lines`` with the translated ``core``; zh and ja take no separator.
    """
    w = Window.partitionBy(owner).orderBy(order)
    before_text = F.lag(F.col("kind") == "text").over(w)
    before_tail = F.lag("tail").over(w)
    gap = (F.col("kind") == "text") & before_text & (F.col("lead") == "") & (before_tail == "")
    sep = F.when(gap & ~target.isin("zh", "ja"), " ").otherwise("")
    marked = parts.withColumn("piece", F.concat(sep, "lead", "core", "tail"))
    return marked.groupBy(owner).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("piece").alias("p")))), lambda x: x["p"]), "").alias("text"))


def evenly(n: Column, count: int) -> Column:
    """At most ``count`` ordinals spread evenly over 0 .. n-1, both ends included."""
    k = F.least(n, F.lit(count))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("int"))).otherwise(F.array().cast("array<int>"))


def allocate(text: str, lengths: list[int]) -> list[str]:
    """``text`` dealt out over spans of the given former lengths.

    Each inner border lies in proportion to the former lengths and moves to the nearest end of a run of white space, or stays
    where it is in a text without any. Borders in order move to places in order, so all are found at once by binary search.
    """
    if not lengths:
        return []
    n = len(text)
    wanted = np.rint(n * np.cumsum(lengths[:-1], dtype=np.float64) / max(1, sum(lengths))).astype(np.int64)
    places = np.unique([0, n, *(m.end() for m in SPACE.finditer(text))])
    if len(places) > 2 or SPACE.search(text):
        right = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
        left = np.maximum(right - 1, 0)
        nearer = wanted - places[left] <= places[right] - wanted  # of two equally near places the first
        wanted = np.where(nearer, places[left], places[right])
    borders = [0, *wanted.tolist(), n]
    return [text[a:b] for a, b in zip(borders, borders[1:])]


def reallocate(df: DataFrame, owner: str, text: str, lengths: str) -> DataFrame:
    """owner, span_ord, span_text: each owner's text over its spans; a null text or no spans gives none. A text that is not
    changed should not come here: its spans already hold it."""
    schema = f"{owner} {df.schema[owner].dataType.simpleString()}, spans array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [allocate(t, ls) for t, ls in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.string()))], names=[owner, "spans"])

    rows = df.where(F.col(text).isNotNull() & (F.size(lengths) > 0)).select(owner, text, lengths)
    return rows.mapInArrow(run, schema).select(owner, F.posexplode("spans").alias("span_ord", "span_text"))
