"""The document job end to end: packages, groups, protected pieces, translations, packages again.

A group of text nodes is cut into addresses, which no model sees, and bounded pieces between them. Every different piece of a
language is translated once. The new text is dealt out over the group's nodes, unless nothing changed. Names come from a template.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.operators.segments import bounded_pieces, evenly, reallocate
from docflow.sources import word

Infer = Callable[[list[str], list[str]], list[str]]  # texts and their languages to translations, one for each


@dataclass(frozen=True)
class Config:
    """What a job is to do. ``source`` auto: the language of every document is looked for; ``output`` null: beside the sources."""

    source: str = "auto"
    target: str = "ru"
    template: str = "{name}_{lang}"
    output: str | None = None
    filenames: bool = False
    directories: bool = False


def upper_double(texts: list[str], _: list[str]) -> list[str]:
    """A test double for a model: large letters. Not a translation."""
    return [t.upper() for t in texts]


ADDRESS = re.compile(T.ADDRESS_PY)
PIECES = "piece_ord int, lead string, core string, tail string, spoken boolean"


def protected_pieces(text: str, limit: int = T.MAX_SEGMENT) -> list[tuple[str, str, str, bool]]:
    """(white space, core, white space, whether it is to be translated) of each piece; put together they are the text."""
    out, at = [], 0
    for m in [*ADDRESS.finditer(text), None]:
        for piece in bounded_pieces(text[at : m.start() if m else len(text)], limit):
            core = piece.strip()
            lead = piece[: len(piece) - len(piece.lstrip())] if core else piece
            out.append((lead, core, piece[len(lead) + len(core) :], any(map(str.isalpha, core))))
        if m:
            out.append(("", m.group(), "", False))
            at = m.end()
    return out


def group_texts(nodes: DataFrame) -> DataFrame:
    """path, part, group_id, text, lengths (of its nodes) of every group of readable packages."""
    good = nodes.where("error is null and part is not null")
    g = good.groupBy("path", "part", "group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "text"))), lambda x: x["text"]).alias("texts"))
    return g.select("path", "part", "group_id", F.array_join("texts", "").alias("text"), F.transform("texts", lambda t: F.length(t)).alias("lengths"))


def pieces(groups: DataFrame) -> DataFrame:
    """path, part, group_id and PIECES of every group."""
    keep = ["path", "part", "group_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lead", pa.string()), ("core", pa.string()), ("tail", pa.string()), ("spoken", pa.bool_())]))
        for b in batches:
            got = [[dict(zip(("lead", "core", "tail", "spoken"), x)) for x in protected_pieces(t)] for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(got, kind)], names=[*keep, "pieces"])

    cut = groups.select(*keep, "text").mapInArrow(run, "path string, part string, group_id int, pieces array<struct<lead:string,core:string,tail:string,spoken:boolean>>")
    return cut.select(*keep, F.posexplode("pieces").alias("piece_ord", "p")).select(*keep, "piece_ord", "p.*")


def samples(cut: DataFrame) -> DataFrame:
    """path, sample: up to 24 pieces of every document, evenly spread, of 320 characters each; documents without any have none."""
    own = cut.where("spoken").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "group_id", "piece_ord", F.concat("lead", "core", "tail").substr(1, 320).alias("t")))).alias("all"))
    picks = F.array_distinct(evenly(F.size("all"), 24))
    return own.select("path", F.array_join(F.transform(picks, lambda i: F.get("all", i)["t"]), "\n").alias("sample"))


def sources_of(cut: DataFrame, config: Config, resolve: Callable[[Column], Column]) -> DataFrame:
    """path, source: a document's language, of its sample if the job doesn't name one."""
    own = samples(cut)
    return own.select("path", (resolve(F.col("sample")) if config.source == "auto" else F.lit(config.source)).alias("source"))


def translated(asked: DataFrame, infer: Infer, target: str) -> DataFrame:
    """source, core, said of every different core of every language; a text in the target language comes back as it is.

    A blank answer to a text is an error of the text, kept as a null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [t.strip() or None for t in infer(b.column(1).to_pylist(), b.column(0).to_pylist())] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string())], names=["source", "core", "said"])

    return asked.where(F.col("source") != target).select("source", "core").distinct().mapInArrow(run, "source string, core string, said string")


def translate_groups(nodes: DataFrame, infer: Infer, config: Config = Config(), resolve: Callable[[Column], Column] = T.main_script) -> DataFrame:
    """path, part, group_id, node_ord, text, error: the nodes of all groups whose text changes.

    A group with a piece that got no answer gives one row with an error instead.
    """
    groups = group_texts(nodes)
    cut = pieces(groups)
    owned = cut.join(sources_of(cut, config, resolve), "path", "left")
    said = translated(owned.where("spoken"), infer, config.target)
    both = owned.join(said, ["source", "core"], "left")
    asked = F.col("spoken") & (F.col("source") != config.target)
    new = F.when(asked, F.concat("lead", "said", "tail")).otherwise(F.concat("lead", "core", "tail"))
    made = both.withColumn("new", new).groupBy("path", "part", "group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_ord", F.coalesce("new", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("new"), F.max(F.col("new").isNull()).alias("bad"))
    changed = groups.join(made, ["path", "part", "group_id"]).where("bad or new <> text").withColumn("key", F.to_json(F.struct("path", "part", "group_id")))
    out = reallocate(changed.where("not bad"), "key", "new", "lengths")
    k = F.from_json("key", "path string, part string, group_id int")
    good = out.select(k.alias("k"), F.col("span_ord").alias("node_ord"), F.col("span_text").alias("text")).select("k.*", "node_ord", "text", F.lit(None).cast("string").alias("error"))
    bad = changed.where("bad").select("path", "part", "group_id", F.lit(None).cast("int").alias("node_ord"), F.lit(None).cast("string").alias("text"), F.lit("EmptyOutput").alias("error"))
    return good.unionByName(bad)


def destinations(files: DataFrame, languages: DataFrame, config: Config, root: str | None, infer: Infer) -> DataFrame:
    """path, folder, name, suffix of every package's output.

    Without a root the folder is the output's or the package's own. With one, the root's name goes through the template, and the
    folders between keep their names or are translated from the language of the first package below them, once for each folder.
    """
    p = files.select("path", F.regexp_replace("path", r"^file:(?://)?", "").alias("at")).join(languages, "path", "left").withColumn("source", F.coalesce("source", F.lit(config.target)))
    p = p.withColumn("file", F.element_at(F.split("at", "/"), -1)).withColumn("parent", F.regexp_replace("at", r"/[^/]*\z", ""))
    stem = T.stem(F.col("file"))
    if config.filenames:
        asked = p.select("source", stem.alias("core")).where(T.has_letter(F.col("core")))
        p = p.withColumn("core", stem).join(translated(asked, infer, config.target), ["source", "core"], "left")
        base = T.safe_base(F.coalesce("said", "core"), F.col("core"))
    else:
        base = stem
    p = p.withColumn("name", T.safe_name(T.expand_template(F.lit(config.template), base, F.lit(config.target)))).withColumn("suffix", T.suffix(F.col("file")))
    if root is None:
        folder = F.lit(config.output) if config.output else F.col("parent")
        return p.select("path", folder.alias("folder"), "name", "suffix")
    top, above = root.rstrip("/").rsplit("/", 1)[1], root.rstrip("/").rsplit("/", 1)[0]
    inner = F.filter(F.split(F.substr("parent", F.lit(len(root.rstrip("/")) + 1)), "/"), lambda x: x != "")
    ups = F.transform(F.sequence(F.lit(0), F.size("inner")), lambda i: F.array_join(F.slice("inner", 1, i), "/"))
    steps = p.withColumn("inner", inner).select("path", "at", "source", F.posexplode(ups).alias("depth", "dir"))
    dirs = steps.groupBy("dir").agg(F.min_by("source", "at").alias("source")).withColumn("core", F.when(F.col("dir") == "", F.lit(top)).otherwise(F.element_at(F.split("dir", "/"), -1)))
    if config.directories:
        dirs = dirs.join(translated(dirs.where(T.has_letter(F.col("core"))), infer, config.target), ["source", "core"], "left").withColumn("core", F.coalesce("said", "core"))
    named = F.when(F.col("dir") == "", T.safe_name(T.expand_template(F.lit(config.template), F.col("core"), F.lit(config.target)))).otherwise(T.safe_name(F.col("core")))
    whole = steps.join(dirs.select("dir", named.alias("as")), "dir").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "as"))), lambda x: x["as"]), "/").alias("below"))
    return p.join(whole, "path").select("path", F.concat(F.lit((config.output or above).rstrip("/") + "/"), "below").alias("folder"), "name", "suffix")


def still_there(path: str, sha: str) -> bool:
    """Whether a file still holds what was read; paths of other file systems are taken to."""
    at = re.sub(r"^file:(?://)?", "", path)
    if "://" in at:
        return True
    try:
        with open(at, "rb") as f:
            return hashlib.sha256(f.read()).hexdigest() == sha
    except OSError:
        return False


NUMBERS = 10_000  # names that are tried for an output


def run_job(files: DataFrame, infer: Infer, config: Config = Config(), root: str | None = None, resolve: Callable[[Column], Column] = T.main_script) -> DataFrame:
    """path, source, segments, output, error of every package (path, content).

    Packages are written by the tasks that hold their bytes; only texts are shuffled. An output whose name is taken gets a number;
    a package that changed after it was read, or got an empty answer, isn't published.
    """
    nodes = word.read_nodes(files)
    cut = pieces(group_texts(nodes))
    languages = sources_of(cut, config, resolve)
    counts = cut.where("spoken").groupBy("path").agg(F.count("*").alias("segments"))
    made = translate_groups(nodes, infer, config, resolve).groupBy("path").agg(F.collect_list(F.struct("part", "group_id", "node_ord", "text", "error")).alias("nodes"))
    plan = destinations(files, languages, config, root, infer).join(languages, "path", "left").join(counts, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, ns, folder, name, suffix, source, n in zip(*(c.to_pylist() for c in b.columns)):
                out, error = None, next((x["error"] for x in ns or [] if x["error"]), None)
                new: dict[tuple[str, int], list[tuple[int, str]]] = {}
                for x in ns or []:
                    new.setdefault((x["part"], x["group_id"]), []).append((x["node_ord"], x["text"]))
                try:
                    shape, sha = word.structure(content), hashlib.sha256(content).hexdigest()
                    package = None if error else word.rewrite(content, {k: [t for _, t in sorted(v)] for k, v in new.items()})
                    for k in range(NUMBERS if package else 0):
                        out = f"{folder}/{name}{f' ({k})' if k else ''}{suffix}"
                        error = word.publish(out, package, shape, lambda: still_there(path, sha))  # noqa: B023 - called at once
                        if error != "exists":
                            break
                except (word.BadPackage, OSError, SyntaxError, KeyError, ValueError) as e:
                    error = type(e).__name__
                rows.append((path, source, n or 0, None if error else out, error))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["path", "source", "segments", "output", "error"])

    fed = files.select("path", "content").join(made, "path", "left").join(plan, "path", "left").select("path", "content", "nodes", "folder", "name", "suffix", "source", "segments")
    return fed.mapInArrow(run, "path string, source string, segments bigint, output string, error string")


def unfinished(jobs: DataFrame, enabled: bool, present: DataFrame) -> DataFrame:
    """The jobs to take up again: none unless that is wanted, and only those whose file is among ``present`` (path)."""
    return jobs.join(present.select("path").distinct(), "path", "left_semi") if enabled else jobs.limit(0)
