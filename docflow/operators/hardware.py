"""A machine's profile and what it recommends; labels and choices of languages and modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a graphics card that isn't known, and the numbers of threads that may be chosen. Fixed values.
NO_CARD, THREADS = "Не определена", (2, 4, 6, 8, 12, 16)
#: English names of modes. Fixed values.
MODES = {"Economy": "Эконом", "Fast": "Быстрый", "Balanced": "Баланс", "Turbo": "Турбо", "Maximum": "Максимум"}
AUTOMATIC = "auto"


def probe_number(output: Column) -> Column:
    """Gigabytes of the greatest of the numbers that stand alone on a probe's lines (in megabytes), at least 1; null for none."""
    lines = F.transform(F.filter(F.transform(F.split(output, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+\z")), lambda x: x.try_cast("bigint"))
    return F.when(F.size(lines) > 0, F.greatest(F.lit(1), F.bround(F.array_max(lines) / 1024).cast("bigint")))


def recommend(machines: DataFrame) -> DataFrame:
    """``machines`` (ram_gb, gpu, logical_cores, vram_gb) with device, mode, threads, gpu_usage, ram_limit, vram_limit."""
    card = F.col("gpu").isNotNull() & (F.col("gpu") != NO_CARD)
    ram, half = F.coalesce("ram_gb", F.lit(0)), F.coalesce(F.floor(F.col("logical_cores") / 2), F.lit(0))
    most = F.least(F.greatest(half, F.lit(2)), F.lit(16))
    turbo, balanced = (ram >= 32) & card, ram >= 16
    return machines.select(
        "*",
        F.when(card, "GPU").otherwise("CPU").alias("device"),
        F.when(turbo, "Турбо").when(balanced, "Баланс").otherwise("Эконом").alias("mode"),
        F.array_max(F.filter(F.array(*map(F.lit, THREADS)), lambda x: x <= most)).alias("threads"),
        F.when(card, "Предпочтительно").otherwise("Отключено").alias("gpu_usage"),
        F.when(turbo, "24 GB").when(balanced, "12 GB").when(ram >= 8, "6 GB").otherwise("2 GB").alias("ram_limit"),
        F.when(F.coalesce("vram_gb", F.lit(0)) == 0, "Автоматически").otherwise(F.concat(F.greatest(F.lit(1), F.col("vram_gb") - 2).cast("string"), F.lit(" GB"))).alias("vram_limit"),
    )


def as_json(machines: DataFrame, *columns: str) -> DataFrame:
    """hardware: each machine's named columns as JSON; nulls are kept."""
    return machines.select(F.to_json(F.struct(F.struct(*columns).alias("hardware")), {"ignoreNullFields": "false"}).alias("hardware"))


def mode_label(label: Column) -> Column:
    """A mode's name without the sign and two blanks before it; English names become the interface's."""
    plain = F.when(F.instr(label, "  ") > 0, label.substr(F.instr(label, "  ") + 2, F.length(label))).otherwise(label)
    names = F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv])
    return F.coalesce(names[plain], plain)


def swapped(source: Column, target: Column) -> tuple[Column, Column]:
    """Source and target of a pair the other way round."""
    return target, source


def distinct_pair(source: Column, target: Column, changed: Column) -> tuple[Column, Column]:
    """A pair whose sides differ: where both name one language, the side that wasn't changed becomes automatic."""
    clash = (source == target) & (source != AUTOMATIC)
    return F.when(clash & (changed != "source"), AUTOMATIC).otherwise(source), F.when(clash & (changed == "source"), AUTOMATIC).otherwise(target)
