"""Files and folders as rows: choosing, naming, numbering, counting, integrity, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import inside, stem, suffix
from docflow.operators.ordered import running

#: Names that mark working copies and hidden files. Fixed values.
SKIP = r"^(?:~\$|\.)"


def status(name: Column, kind: str = ".docx") -> Column:
    """file or skipped: only the wanted suffix in any letter case, no working copies, no hidden files."""
    return F.when(F.lower(name).endswith(kind) & ~name.rlike(SKIP), "file").otherwise("skipped")


def first_of(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of every key. Null keys are one key.

    A key that a third of all rows share is reduced before the shuffle: the least order wins in each partition first.
    """
    cols = df.columns
    packed = df.select(key.alias("__k"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[df[c].alias(c) for c in cols]).alias("row")).alias("__v"))
    best = packed.groupBy("__k").agg(F.min_by("__v", F.struct(*[F.col("__v")[f"o{i}"] for i in range(len(order))])).alias("v"))
    return best.select(*[F.col("v.row")[c].alias(c) for c in cols])


def numbered(df: DataFrame, folder: str, base: str, extension: Column, order: str, taken: DataFrame | None = None) -> DataFrame:
    """``df`` with final_name: the n-th of equal names in a folder gets " (n)"; names in ``taken`` (folder, name) are passed over.

    Equal names are counted by running sums over a distributed sort, however many a folder has. A name that looks numbered itself
    is a base of its own; only ``taken`` names are compared with generated ones.
    """
    name = lambda n: F.concat(F.col(base), F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.lit("")), F.col("__e"))
    rows = df.withColumn("__e", extension).withColumn("__one", F.lit(1).cast("bigint"))
    out = running(rows, [folder, base, "__e"], [order], "__one").withColumnRenamed("below", "__n").drop("__one", "total")
    if taken is None:
        return out.withColumn("final_name", name(F.col("__n"))).drop("__n", "__e")
    used = taken.select(F.col("folder").alias("f"), F.col("name").alias("t")).distinct()
    # taken names of the same base take numbers away: the k-th file gets the k-th free number
    own = out.select(folder, base, "__e").distinct()
    hit = own.join(used, F.col(folder) == F.col("f"))
    escaped = F.length(base)
    rest = F.col("t").substr(escaped + 1, F.length("t") - escaped - F.length("__e"))
    number = F.when(rest == "", 0).otherwise(F.regexp_extract(rest, r"^ \((\d{1,9})\)\z", 1).try_cast("bigint"))
    busy = hit.where(F.col("t").startswith(F.col(base)) & F.col("t").endswith(F.col("__e")) & number.isNotNull()).groupBy(folder, base, "__e").agg(F.array_sort(F.collect_set(number)).alias("__busy"))
    joined = out.join(busy, [folder, base, "__e"], "left")
    free = F.aggregate(F.coalesce("__busy", F.array().cast("array<bigint>")), F.col("__n"), lambda acc, b: F.when(b <= acc, acc + 1).otherwise(acc))
    return joined.withColumn("final_name", name(free)).drop("__n", "__busy", "__e")


def ancestors(path: Column) -> Column:
    """All folders above a path with / between parts, from the top; the root is the empty string."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def tree_counts(files: DataFrame, path: str, selected: str) -> DataFrame:
    """folder, files, folders (below it, at any depth) and state (all, none, partial by the files' selection) of every folder."""
    rows = files.where(F.col(path).isNotNull()).select(F.col(path).alias("p"), F.col(selected).alias("s"), ancestors(F.col(path)).alias("up"))
    counts = rows.select(F.explode("up").alias("folder"), "s").groupBy("folder").agg(F.count("*").alias("files"), F.min(F.col("s").cast("int")).alias("lo"), F.max(F.col("s").cast("int")).alias("hi"))
    folders = rows.select(F.explode("up").alias("f")).distinct().where("f <> ''")
    below = folders.select(F.explode(ancestors(F.col("f"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("folders"))
    state = F.when(F.col("lo") == F.col("hi"), F.when(F.col("lo") == 1, "all").otherwise("none")).otherwise("partial")
    return counts.join(below, "folder", "left").select("folder", "files", F.coalesce("folders", F.lit(0)).alias("folders"), state.alias("state"))


def differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, state of every file of either side: ok, missing, extra, size or hash. Columns: key, size, sha."""
    e = expected.select(F.col(key), F.col("size").alias("es"), F.col("sha").alias("eh"), F.lit(True).alias("e"))
    a = actual.select(F.col(key), F.col("size").alias("as"), F.col("sha").alias("ah"), F.lit(True).alias("a"))
    j = e.join(a, key, "full")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(~F.col("es").eqNullSafe(F.col("as")), "size").when(~F.col("eh").eqNullSafe(F.col("ah")), "hash").otherwise("ok")
    return j.select(key, state.alias("state"))


MODEL = "id string, path string, languages array<string>, pairs array<array<string>>, files array<struct<path:string,size:bigint,sha256:string>>, size bigint"


def manifest_errors(models: DataFrame) -> DataFrame:
    """id, errors (in order, empty if the record is good) of every model record."""
    files = F.coalesce("files", F.array().cast("array<struct<path:string,size:bigint,sha256:string>>"))
    total = F.aggregate(files, F.lit(0).cast("bigint"), lambda a, f: a + F.coalesce(f["size"], F.lit(0).cast("bigint")))
    w = Window.partitionBy("id")
    checks = {
        "id": ~F.coalesce(F.col("id").rlike(r"^[a-z0-9][a-z0-9._-]*\z"), F.lit(False)),
        "duplicate_id": F.count("*").over(w) > 1,
        "no_files": F.size(files) == 0,
        "sha": F.exists(files, lambda f: ~F.coalesce(f["sha256"].rlike(r"^[0-9a-f]{64}\z"), F.lit(False))),
        "file_size": F.exists(files, lambda f: F.coalesce(f["size"] < 0, F.lit(True))),
        "size": ~total.eqNullSafe(F.col("size")),
        "duplicate_file": F.size(F.array_distinct(F.transform(files, lambda f: f["path"]))) < F.size(files),
        "pair": F.exists(F.coalesce("pairs", F.array().cast("array<array<string>>")), lambda p: F.size(p) != 2),
        "path": ~inside(F.col("path")) | F.exists(files, lambda f: ~inside(f["path"])),
    }
    return models.select("id", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in checks.items()])).alias("errors"))


def model_states(models: DataFrame, files: DataFrame, known: DataFrame, full: bool) -> DataFrame:
    """id, state, error of every model record: AVAILABLE, MISSING or CORRUPTED, or what is in use already (LOADING, READY).

    ``files``: id, path, size, sha256 of what is there (sha256 may be null unless ``full``); ``known``: id, state from before. A
    model known to be corrupted stays so for checks of sizes alone, and only a full check can clear it. A missing file is found
    before files after it are looked at, in the order of the manifest; a file of another size, or in a full check of another hash, is corrupt.
    """
    want = models.select("id", F.posexplode("files").alias("ord", "f")).select("id", "ord", F.col("f.path").alias("path"), F.col("f.size").alias("want"), F.lower("f.sha256").alias("want_sha"))
    have = files.select("id", "path", F.col("size").alias("have"), F.lower("sha256").alias("have_sha"))
    bad = F.when(F.col("have").isNull(), "MISSING").when(F.col("have") != F.col("want"), "CORRUPTED")
    if full:
        bad = bad.when(~F.col("have_sha").eqNullSafe(F.col("want_sha")), "CORRUPTED")
    first = want.join(have, ["id", "path"], "left").withColumn("bad", bad).groupBy("id").agg(F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("ord"))).alias("bad"))
    all_ = models.select("id").distinct().join(first, "id", "left").join(known.select("id", F.col("state").alias("old")), "id", "left")
    sticky = (F.col("old") == "CORRUPTED") & F.lit(not full)
    state = F.when(sticky, "CORRUPTED").when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("old").isin("LOADING", "READY"), F.col("old")).otherwise("AVAILABLE")
    error = F.when(sticky | (F.col("bad") == "CORRUPTED"), "ModelCorrupted").when(F.col("bad") == "MISSING", "ModelMissing")
    return all_.select("id", state.alias("state"), error.alias("error"))


def discovered(found: DataFrame, models: DataFrame, root: str) -> DataFrame:
    """``found`` (path and more) with the id of the model record whose place under ``root`` it is; packages of no record have null.

    Places are compared without "." parts and repeated separators; records that lie outside the root are no one's.
    """
    plain = lambda c: F.array_join(F.filter(F.split(c, r"[/\\\\]+"), lambda x: (x != "") & (x != ".")), "/")
    known = models.where(inside(F.col("path"))).select(plain(F.concat(F.lit(root.rstrip("/") + "/"), F.col("path"))).alias("__at"), F.col("id").alias("model_id"))
    return found.withColumn("__at", plain(F.col("path"))).join(known, "__at", "left").drop("__at")


def newest_compatible(index: DataFrame, key: str, version: str, most: str) -> DataFrame:
    """The row of the greatest version of every key of a package index that isn't beyond ``most``."""
    number = lambda c: F.transform(F.split(c, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))
    return newest(index.where(number(F.col(version)) <= number(F.lit(most))), key, version)


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of ``new`` in the place of rows of the same key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def file_parts(name: Column) -> tuple[Column, Column]:
    return stem(name), suffix(name)


def newest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of every key; versions are compared number by number, "1.10" after "1.9"."""
    parts = F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))
    best = df.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*df.columns), parts).alias("r"))
    return best.select(*[F.col("r")[c].alias(c) for c in df.columns])
