"""Queries of the training-data operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import bpe, langid, lookalikes, mixing, pairs, pieces, quality, ranks, sentences, truncation
from docflow.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.label_findings(
        table(spark, d, "requests", "request_id", "text", "source_language"),
        table(spark, d, "documents", "doc_id", "text", "lang", "job_id"),
        table(spark, d, "document_configs", "job_id", "source"),
        table(spark, d, "common_words"),
    )


def p1_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language of every document, with its confidence."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    profiles = langid.train(docs, table(spark, d, "common_words"))
    got = langid.languages(docs, "text", profiles, "doc_id", junk=False)
    return got.select("doc_id", F.col("lang").alias("doc_lang"), F.col("confidence").alias("doc_confidence"), F.posexplode("stretches").alias("ord", "s")).select("doc_id", "doc_lang", "doc_confidence", "ord", "s.start", "s.stop", "s.lang", "s.confidence")


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "results", "result_id", "request_id", "translated_text", "backend", "options_id"), table(spark, d, "requests", "request_id", "text"), table(spark, d, "inference_options", "options_id", "max_decoding_length")


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(*_answers(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where("truncated").select("result_id").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(_truncated(spark, d))


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    """The hidden limits of every setting by each way of counting."""
    results, _, options = _answers(spark, d)
    return truncation.hidden_limits(truncation.measured(results.where("translated_text is not null"), "translated_text", "options_id"), options)


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split(table(spark, d, "segments", "segment_id", "text", "options_id"), table(spark, d, "inference_options"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).where("piece_ord = 0").select("segment_id").distinct()


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(
        table(spark, d, "segments", "segment_id", "job_id", "text", "translated"),
        table(spark, d, "document_configs", "job_id", "target"),
        table(spark, d, "requests", "request_id", "text", "received_at"),
        table(spark, d, "results", "result_id", "request_id", "translated_text", "target_language"),
        table(spark, d, "documents", "doc_id", "text", "lang"),
        table(spark, d, "common_words"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.first_defect(p4_labels(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    a = sentences.sentences(table(spark, d, "segments", "segment_id", "text"), "segments", "segment_id")
    return a.unionByName(sentences.sentences(table(spark, d, "benchmark_corpus", "case_no", "text"), "benchmark_corpus", "case_no"))


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    counted = ranks.durations(table(spark, d, "results", "backend", "device", "duration_ms"))
    return ranks.percentiles(counted, ["backend", "device"], "value", "n", ranks.SHARES)


def p6_daily(spark: SparkSession, d: str) -> DataFrame:
    counted = ranks.durations(table(spark, d, "results", "backend", "device", "duration_ms", "completed_at"), F.to_date("completed_at").alias("day"))
    return ranks.percentiles(counted, ["backend", "device", "day"], "value", "n", ranks.SHARES)


def p6_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from the separate days' counts, added up: the same as those of all rows."""
    days = ranks.durations(table(spark, d, "results", "backend", "device", "duration_ms", "completed_at"), F.to_date("completed_at").alias("day"))
    return ranks.percentiles(days.groupBy("backend", "device", "value").agg(F.sum("n").alias("n")), ["backend", "device"], "value", "n", ranks.SHARES)


def _looks(spark: SparkSession, d: str, what: Callable[..., DataFrame]) -> DataFrame:
    a = what(table(spark, d, "segments", "segment_id", "doc_id", "text"), "segments", "segment_id", "text", ["doc_id"])
    return a.unionByName(what(table(spark, d, "entries", "entry_id", "source", "target", "key"), "entries", "entry_id", "key", ["source", "target"]))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _looks(spark, d, lookalikes.same_look)


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every row with look-alikes, its class and the number of its links."""
    return _looks(spark, d, lookalikes.look_classes)


def p7_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical_column(table(spark, d, "segments", "segment_id", "text"), "text", "segment_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents", "doc_id", "text"))


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.plan(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(*_plan(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_plan(spark, d))


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    docs, words = table(spark, d, "documents", "doc_id", "text", "lang"), table(spark, d, "common_words")
    return quality.kinds(docs, words, table(spark, d, "doc_labels", "doc_id", "kind"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_stats(spark, d).where("kind <> 'prose'").select("doc_id", "kind").distinct()


def queries() -> dict[str, Query]:
    """All queries of this subpackage."""
    fs = [p1_found, p1_stretches, p2_found, p2_rates, p2_limits, p3_found, p3_pieces, p4_found, p4_labels, p5_found, p6_percentiles, p6_daily, p6_combined, p7_found, p7_classes, p7_canonical, p8_ids, p9_mixture, p9_shares, p10_found, p10_stats]
    return {f.__name__: f for f in fs}


def _percentile_sql(groups: str, day: str = "") -> str:
    cols = ", ".join(f"round(quantile_cont(duration_ms, {p}), 6) AS {name}" for name, p in ranks.SHARES.items())
    return f"SELECT {groups}, count(*) AS n, {cols} FROM (SELECT backend, device, duration_ms{day} FROM results WHERE duration_ms IS NOT NULL AND NOT isnan(duration_ms) AND NOT isinf(duration_ms) AND duration_ms >= 0) GROUP BY ALL"


def oracle_sql() -> dict[str, str]:
    return {
        "p6_percentiles": _percentile_sql("backend, device"),
        "p6_daily": _percentile_sql("backend, device, day", ", CAST(completed_at AS DATE) AS day"),
        "p6_combined": _percentile_sql("backend, device"),
    }
