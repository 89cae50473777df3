"""Carrying out routes: attempts in order over backends, devices and number formats until one succeeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.operators.routing import compute_types, devices


class DeviceUnavailable(RuntimeError):
    """A device can't be used; another number format on it may."""


class Cancelled(RuntimeError):
    """The request was taken back: nothing else is tried."""


class Runner(Protocol):
    """Runs one attempt; built once in every Python worker."""

    def __call__(self, backend: str, kind: str, device: str, compute: str, source: str, target: str, text: str) -> str: ...


def probed(capabilities: DataFrame, backends: DataFrame) -> DataFrame:
    """backend, pairs (array of source, target, kind), devices, failure of every backend of ``backends`` (backend, failure, devices).

    A backend whose probe failed keeps its error and offers nothing, whatever it offered before.
    """
    of = capabilities.groupBy("backend").agg(F.collect_set(F.struct("source", "target", "kind")).alias("pairs"))
    none = F.array().cast("array<struct<source:string,target:string,kind:string>>")
    ok = F.col("failure").isNull()
    offered = F.when(ok, F.coalesce("devices", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return backends.join(of, "backend", "left").select("backend", F.when(ok, F.coalesce("pairs", none)).otherwise(none).alias("pairs"), offered.alias("devices"), "failure")


def only_backend(requests: DataFrame, capabilities: DataFrame, backend: str) -> DataFrame:
    """``requests`` with backend, kind, reason, fallbacks (none) and error, by one backend alone: its direct route, else its pivot route."""
    own = capabilities.where(F.col("backend") == backend).groupBy(F.col("source").alias("__s"), F.col("target").alias("__t")).agg(F.min("kind").alias("__kind"))  # direct before pivot
    some = capabilities.where(F.col("backend") == backend).agg((F.count("*") > 0).alias("__some"))
    r = requests.join(own, (F.col("source") == F.col("__s")) & (F.col("target") == F.col("__t")), "left").join(F.broadcast(some))  # one row
    same = F.col("source") == F.col("target")
    hit = F.col("__kind").isNotNull()
    return r.select(
        *requests.columns,
        F.when(same, "passthrough").when(hit, F.lit(backend)).alias("backend"),
        F.when(same, "none").when(hit, F.col("__kind")).alias("kind"),
        F.when(same, "source equals target").when(hit, F.format_string("benchmark %s route", "__kind")).alias("reason"),
        F.lit("").alias("fallbacks"),
        F.when(~same & ~F.col("__some"), "model_missing").when(~same & ~hit, "unsupported_language").alias("error"),
    )


def planned(preference: Column, auto_gpu: Column, candidates: Column, offered: dict[str, Column], gpu: Column, formats: dict[str, Column]) -> Column:
    """Attempts in order: struct(backend, kind, device, compute) for every candidate ("backend:kind"), device and number format.

    A candidate without a usable device, and a device without a usable format, is an attempt too, with a null device or format: it
    fails before anything runs. ``offered``: devices of each backend; ``formats``: number formats of each device.
    """
    kinds = "array<struct<backend:string,kind:string,device:string,compute:string>>"

    def of(c: Column) -> Column:
        backend, kind = F.split_part(c, F.lit(":"), F.lit(1)), F.split_part(c, F.lit(":"), F.lit(2))
        have = F.lit(None).cast("array<string>")
        for name, ds in offered.items():
            have = F.when(backend == name, ds).otherwise(have)
        usable = devices(preference, auto_gpu, F.coalesce(have, F.array().cast("array<string>")), gpu)

        def per(d: Column) -> Column:
            fit = compute_types(d, F.when(d == "cuda", formats["cuda"]).otherwise(formats["cpu"]))
            some = F.when(F.size(fit) > 0, fit).otherwise(F.array(F.lit(None).cast("string")))
            return F.transform(some, lambda x: F.struct(backend.alias("backend"), kind.alias("kind"), d.alias("device"), x.alias("compute")))

        none = F.array(F.struct(backend.alias("backend"), kind.alias("kind"), F.lit(None).cast("string").alias("device"), F.lit(None).cast("string").alias("compute")))
        return F.when(F.size(usable) > 0, F.flatten(F.transform(usable, per))).otherwise(none)

    return F.flatten(F.transform(candidates, of)).cast(kinds)


OUTCOME = "translated string, backend string, kind string, device string, compute string, tries int, fallback_used boolean, error string, log array<string>"


def tried(text: str, source: str, target: str, plan: list[dict], run: Runner, failure: str | None) -> tuple:
    """The OUTCOME of one text: the first success of its plan, or the last error. A text that needs no translation isn't tried.

    After a device's failure the device's next number format is tried; after any other error the next device. A cancelled request
    falls back to nothing. A blank answer is a failure. Log lines never hold texts or messages, which may quote them.
    """
    if len(text) > T.MAX_TEXT:
        return None, None, None, None, None, 0, False, "InputTooLong", []
    if not text.strip() or source == target:
        return text, "passthrough", "none", None, None, 0, False, None, []
    tries, error, skip, log = 0, failure or "BackendUnavailable", None, []
    for a in plan:
        place = (a["backend"], a["kind"], a["device"])
        if place == skip:
            continue
        fallback = tries > 0
        tries += 1
        if a["device"] is None or a["compute"] is None:
            error = "DeviceUnavailable"
            continue
        try:
            out = run(a["backend"], a["kind"], a["device"], a["compute"], source, target, text)
            problem = None if out.strip() else "EmptyOutput"
        except Cancelled:
            return None, None, None, None, None, tries, fallback, "Cancelled", log
        except DeviceUnavailable:
            problem = "DeviceUnavailable"
        except Exception as e:  # noqa: BLE001 - on a card an unknown failure is taken for the device's
            problem = "DeviceUnavailable" if a["device"] == "cuda" and not isinstance(e, ValueError) else type(e).__name__
        log.append(f"backend={a['backend']} route={a['kind']} device={a['device']} compute={a['compute']} chars={len(text)} fallback={fallback} error={problem or 'none'}")
        if problem is None:
            return out, a["backend"], a["kind"], a["device"], a["compute"], tries, fallback, None, log
        error = problem
        if problem != "DeviceUnavailable":
            skip = place
    return None, None, None, None, None, tries, tries > 1, error, log


def attempt(df: DataFrame, text: str, source: str, target: str, plan: str, build: Callable[[], Runner], *keep: str, failure: str | None = None) -> DataFrame:
    """The columns ``keep`` and the OUTCOME of every row; ``plan`` is a column as of ``planned``, ``failure`` one of a probe's errors.

    Null texts count as blank ones. Each row is tried on its own: one row's failure leaves the others alone.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", " + OUTCOME
    types = [pa.string()] * 5 + [pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string())]
    names = [x.split(" ")[0] for x in OUTCOME.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner = build()
        for b in batches:
            rows = [tried(t or "", s, g, p or [], runner, f) for t, s, g, p, f in zip(*(c.to_pylist() for c in b.columns[:5]))]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[5:], *(pa.array(list(c), t) for c, t in zip(cols, types))], names=[*keep, *names])

    probe = F.col(failure) if failure else F.lit(None).cast("string")
    return df.select(F.col(text), F.col(source), F.col(target), F.col(plan), probe.alias("__failure"), *keep).mapInArrow(run, schema)
