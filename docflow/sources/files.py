"""Files beside Word packages: archives, manifests, corpora, usage groups, and reports."""

from __future__ import annotations

import io
import os
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators.corpus import MODEL

MAX_MEMBER = 128 * 1024 * 1024
CASES = "cases array<struct<id:string,source:string,target:string,text:string,concepts:array<array<string>>>>"
USAGE = "entries array<struct<source:string,target:string,words:array<string>,note:string,variants:array<array<string>>,related:array<string>>>"


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, content, sha512_ok of the members of .tar.xz archives; sha512_ok is null without a .sha512 file beside.

    Members over MAX_MEMBER bytes, links and broken archives give a row without content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    packed = files.where(F.col("path").endswith(".tar.xz"))
    sums = files.where(F.col("path").endswith(".sha512")).select(F.regexp_replace("path", r"\.sha512\z", "").alias("path"), F.lower(F.regexp_extract(F.decode("content", "UTF-8"), r"([0-9a-fA-F]{128})", 1)).alias("want"))
    checked = packed.withColumn("have", F.sha2("content", 512)).join(sums, "path", "left").select("path", "content", (F.col("have") == F.col("want")).alias("sha512_ok"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, ok in zip(*(c.to_pylist() for c in b.columns)):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r:xz") as t:
                        for m in t:
                            if m.isfile():
                                rows.append((path, m.name, t.extractfile(m).read() if m.size <= MAX_MEMBER else None, ok))
                except (tarfile.TarError, EOFError, OSError, ValueError):
                    rows = [(path, None, None, ok)]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.bool_())], names=["path", "name", "content", "sha512_ok"])

    return checked.mapInArrow(run, "path string, name string, content binary, sha512_ok boolean")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per model record of a manifest; a missing file gives none, another version of the format is an error."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], MODEL)
    doc = spark.read.schema(f"schema_version int, models array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in split_ddl(MODEL)))}>>").json(path, multiLine=True)
    checked = doc.withColumn("models", F.when(F.col("schema_version") == 1, F.col("models")).otherwise(F.raise_error(F.lit("unknown schema_version"))))
    return checked.select(F.explode("models").alias("m")).select("m.*")


def split_ddl(ddl: str) -> list[str]:
    """Fields of a schema string, split at commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """case_ord, id, source, target, text, concepts of a JSON corpus of cases."""
    return spark.read.schema(CASES).json(path, multiLine=True).select(F.posexplode("cases").alias("case_ord", "c")).select("case_ord", "c.*")


def usage(spark: SparkSession, path: str) -> DataFrame:
    """entry_ord, source, target, word, note of the usage groups; an unreadable or missing file gives none."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "entry_ord int, source string, target string, word string, note string")
    doc = spark.read.schema(USAGE).json(path, multiLine=True, mode="PERMISSIVE")
    return doc.select(F.posexplode("entries").alias("entry_ord", "e")).select("entry_ord", "e.source", "e.target", F.explode("e.words").alias("word"), "e.note")


def first_usage(asked: DataFrame, groups: DataFrame) -> DataFrame:
    """source, target, word, entry_ord, note: the first group that has an asked word, or nulls."""
    first = groups.groupBy("source", "target", "word").agg(F.min_by(F.struct("entry_ord", "note"), "entry_ord").alias("g"))
    return asked.join(first, ["source", "target", "word"], "left").select(*asked.columns, "g.entry_ord", "g.note")


def parse_log(line: Column) -> Column:
    """The key=value fields of a log line as a map."""
    return F.str_to_map(F.array_join(F.regexp_extract_all(line, F.lit(r"(\w+=\S+)"), F.lit(1)), " "), F.lit(" "), F.lit("="))


def log_line(fields: dict[str, Column]) -> Column:
    """Fields as key=value in a line; null ones are left out. Never give it a user's text."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.regexp_replace(v.cast("string"), r"\s+", "_")) for k, v in fields.items()])


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns as CSV with a header that begins with the mark of UTF-8; other columns are left out, an existing report
    isn't overwritten. Missing values are empty."""
    head = [F.col(c).alias(("\ufeff" if k == 0 else "") + c) for k, c in enumerate(columns)]
    rows.select(*head).write.mode("errorifexists").option("header", True).option("encoding", "UTF-8").option("emptyValue", "").csv(path)


def write_lexicon(entries: DataFrame, path: str) -> None:
    """The lexicon by language pair, so that a lookup reads its pair only; an existing one isn't overwritten."""
    entries.repartition("source", "target", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("source", "target", "key").write.mode("errorifexists").partitionBy("source", "target").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Append rows to a report of JSON lines: every finished case is kept if a later one fails."""
    rows.write.mode("append").json(path)


def settings(stored: DataFrame, defaults: dict[str, str], renamed: dict[str, dict[str, str]]) -> DataFrame:
    """user and one column for each of ``defaults``: what is stored (user, key, value), old values under their new names, else the default."""
    picked = stored.groupBy("user").pivot("key", list(defaults)).agg(F.max("value"))
    cols = []
    for k, d in defaults.items():
        names = renamed.get(k, {})
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
        cols.append(F.coalesce(table[F.col(k)] if names else F.lit(None), F.col(k), F.lit(d)).alias(k))
    return picked.select("user", *cols)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """One row per profile of a JSON configuration {"profiles": {name: {...}}}."""
    kind = "struct<prefer_quality:boolean,allow_quality:boolean,auto_gpu:boolean,threads:int,beam_size:int,batch_tokens:int>"
    doc = spark.read.schema(f"profiles map<string,{kind}>").json(path, multiLine=True)
    return doc.select(F.explode("profiles").alias("profile", "p")).select("profile", "p.*")


def model_package(content: bytes, most: int = 3 * 1024**3) -> dict[str, bytes]:
    """Members of a packed model below its one folder that holds metadata.json; anything that would leave the folder is refused."""
    import stat
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        if sum(i.file_size for i in infos) > most:
            raise ValueError("too large")
        for i in infos:
            parts = i.filename.replace("\\", "/").split("/")
            if i.filename.startswith(("/", "\\")) or ":" in parts[0] or ".." in parts or stat.S_ISLNK(i.external_attr >> 16):
                raise ValueError("leaves its folder")
        roots = {i.filename.rpartition("/")[0] for i in infos if i.filename.rpartition("/")[2] == "metadata.json"}
        if len(roots) != 1:
            raise ValueError("not one model")
        root = roots.pop()
        return {i.filename[len(root) + 1 if root else 0 :]: z.read(i) for i in infos if not i.is_dir() and (not root or i.filename.startswith(root + "/"))}


def write_text(text: str, path: str) -> None:
    """A small text, such as an attribution, beside its place and then in it, never over an existing file."""
    import tempfile

    fd, temporary = tempfile.mkstemp(prefix=".docflow-", dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
        os.link(temporary, path)
    finally:
        os.unlink(temporary)
