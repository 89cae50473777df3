"""Routes of requests over a graph of translation models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.constants import constant
from docflow.operators.lineage import cut

#: Profiles: prefers quality, allows quality, graphics card on its own, threads, beams, tokens of a batch. Fixed values.
PROFILES = (
    ("economy", False, False, False, 2, 1, 192),
    ("fast", False, True, True, 8, 1, 384),
    ("balanced", False, True, True, 8, 4, 768),
    ("turbo", False, True, True, 8, 2, 1536),
    ("maximum", True, True, True, 8, 5, 768),
    ("automatic", False, True, True, 8, 4, 768),
)
#: Pairs for which the small models are the better ones, and backends' names. Fixed values.
PREFERRED = (("en", "ru"), ("ru", "en"))
PRIMARY, QUALITY = "argos", "m2m100"


def profiles(spark: SparkSession) -> DataFrame:
    return constant(spark, list(PROFILES), "profile string, prefer_quality boolean, allow_quality boolean, auto_gpu boolean, threads int, beam_size int, batch_tokens int")


def paths(edges: DataFrame) -> DataFrame:
    """source, target, kind (direct or pivot), path: for each pair the edge, and the shortest way that doesn't begin with it.

    Of equally short ways the one whose nodes come first in order; of any length. The ways are found breadth first: a step keeps,
    for every first edge and node reached, one way, and goes on only from nodes that it reached for the first time. So there are
    at most edges x nodes ways, and as many steps as the longest shortest way has hops. Null ends and loops are left out.
    """
    e = cut(edges.where("source is not null and target is not null and source <> target").select("source", "target").distinct())
    start = e.select("source", F.col("target").alias("first"), F.col("target").alias("node"), F.array("source", "target").alias("path"))
    seen, front = start, start
    while True:
        step = front.join(e.select(F.col("source").alias("node"), F.col("target").alias("next")), "node").where("next <> source")
        step = step.groupBy("source", "first", F.col("next").alias("node")).agg(F.min(F.array_append("path", F.col("next"))).alias("path"))
        front = cut(step.join(seen, ["source", "first", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    ways = seen.where("first <> node").select("source", F.col("node").alias("target"), "path")
    pivot = ways.groupBy("source", "target").agg(F.min_by("path", F.struct(F.size("path"), "path")).alias("path")).withColumn("kind", F.lit("pivot"))
    direct = e.select("source", "target", F.array("source", "target").alias("path"), F.lit("direct").alias("kind"))
    return direct.unionByName(pivot).select("source", "target", "kind", "path")


def decide(requests: DataFrame, capabilities: DataFrame, policy: DataFrame) -> DataFrame:
    """``requests`` (source, target, profile and more) with backend, kind, reason, fallbacks (array of backend:kind) and error.

    ``capabilities``: backend, source, target, kind. Passthrough if source equals target; without any capability the error is
    model_missing, without one for the pair unsupported_language.
    """
    caps = capabilities.select(F.col("source").alias("cs"), F.col("target").alias("ct"), F.concat_ws(":", "backend", "kind").alias("c")).where("c is not null").groupBy("cs", "ct").agg(F.collect_set("c").alias("caps"))
    some = capabilities.agg((F.count("*") > 0).alias("some"))
    r = requests.join(F.broadcast(policy.select("profile", "prefer_quality", "allow_quality")), "profile", "left")  # one row per profile
    r = r.join(caps, (F.col("source") == F.col("cs")) & (F.col("target") == F.col("ct")), "left").drop("cs", "ct").join(F.broadcast(some))  # one row
    preferred = F.lit(False)
    for s, t in PREFERRED:
        preferred |= (F.col("source") == s) & (F.col("target") == t)
    first = (F.col("prefer_quality") & ~preferred) | (F.col("profile").isin("balanced", "automatic", "turbo") & ~preferred)
    q, p = F.lit(f"{QUALITY}:direct"), F.lit(f"{PRIMARY}:direct")
    wanted = F.when(first, F.array(q, p, F.lit(f"{PRIMARY}:pivot"))).otherwise(F.array(p, q, F.lit(f"{PRIMARY}:pivot")))
    allowed = F.filter(wanted, lambda x: F.array_contains(F.coalesce("caps", F.array().cast("array<string>")), x) & ((x != q) | F.coalesce("allow_quality", F.lit(False))))
    same = F.col("source") == F.col("target")
    r = r.withColumn("order", F.when(same, F.array().cast("array<string>")).otherwise(allowed))
    top = F.col("order")[0]
    none = F.size("order") == 0
    backend, kind = F.split_part(top, F.lit(":"), F.lit(1)), F.split_part(top, F.lit(":"), F.lit(2))
    return r.select(
        *requests.columns,
        F.when(same, "passthrough").when(~none, backend).alias("backend"),
        F.when(same, "none").when(~none, kind).alias("kind"),
        F.when(same, "source equals target").when(~none, F.format_string("%s %s route for %s-%s", kind, F.when(backend == QUALITY, "quality").otherwise("primary"), "source", "target")).alias("reason"),
        F.array_join(F.slice("order", 2, 8), ",").alias("fallbacks"),
        F.when(~same & none & ~F.col("some"), "model_missing").when(~same & none, "unsupported_language").alias("error"),
    )


def devices(preference: Column, auto_gpu: Column, supported: Column, gpu: Column) -> Column:
    """Devices to try in order; an empty array if the wish can't be met. A plain wish never switches."""
    card = F.array_contains(supported, "cuda") & gpu
    cpu = F.array_contains(supported, "cpu")
    none = F.array().cast("array<string>")
    return (
        F.when(preference == "cpu", F.when(cpu, F.array(F.lit("cpu"))).otherwise(none))
        .when(preference == "gpu", F.when(card, F.array(F.lit("cuda"))).otherwise(none))
        .otherwise(F.concat(F.when(card & auto_gpu, F.array(F.lit("cuda"))).otherwise(none), F.when(cpu, F.array(F.lit("cpu"))).otherwise(none)))
    )


#: Number formats in order of preference by device. Fixed values.
COMPUTE = {"cuda": ("int8_float16", "int8_float32", "float32"), "cpu": ("int8", "int8_float32", "float32")}


def compute_types(device: Column, supported: Column) -> Column:
    """Supported number formats in order of preference."""
    wish = F.when(device == "cuda", F.array(*map(F.lit, COMPUTE["cuda"]))).otherwise(F.array(*map(F.lit, COMPUTE["cpu"])))
    return F.array_intersect(wish, supported)


def threads(asked: Column, of_profile: Column, cpus: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(cpus), F.coalesce(asked, of_profile)))


def first_success(attempts: DataFrame, request: str, order: str, ok: str) -> DataFrame:
    """request, winner (order of the first success or null), tries (made until then), fallback_used."""
    win = F.min(F.when(F.col(ok), F.col(order)))
    g = attempts.groupBy(request).agg(win.alias("winner"), F.count("*").alias("all_tries"), F.min(order).alias("first"))
    joined = attempts.join(g.select(request, "winner"), request)
    made = joined.groupBy(request).agg(F.count(F.when(F.col("winner").isNull() | (F.col(order) <= F.col("winner")), 1)).alias("tries"))
    return g.join(made, request).select(request, "winner", "tries", F.coalesce(F.col("winner") > F.col("first"), F.lit(False)).alias("fallback_used"))
