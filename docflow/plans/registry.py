"""Queries over the test tables and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.constants import constant
from docflow.functions import text as T
from docflow.operators import attempts, corpus, hardware, inference, lexicon, metrics, ordered, routing, segments
from docflow.operators.lineage import shared_folder
from docflow.plans import job
from docflow.sources import files, word
from docflow.streaming import timers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


WS = T.WS
NWS = "[^" + T.WS[1:]

# The bounded splitter as a recursion: each step cuts the first piece off the rest.
CUTS = f"""RECURSIVE cuts(doc_id, seg_ord, seg_text, rest) AS (
  SELECT doc_id, -1, '', text FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, seg_ord + 1, left(rest, n), substr(rest, n + 1) FROM (
    SELECT *, CASE WHEN length(rest) <= 1200 THEN length(rest)
      WHEN regexp_matches(left(rest, 1200), '({WS}|[.!?。！？])\\z') THEN 1200
      WHEN length(regexp_replace(left(rest, 1200), '{NWS}+\\z', '')) >= 600 THEN length(regexp_replace(left(rest, 1200), '{NWS}+\\z', ''))
      ELSE 1200 END::INT AS n
    FROM cuts WHERE rest <> '') )"""

ROUTES = "(VALUES ('argos','en','ru','direct'),('argos','ru','en','direct'),('argos','zh','en','direct'),('argos','en','zh','direct'),('argos','de','en','direct'),('argos','en','es','direct'),('argos','fr','de','direct'))"
EDGES = [("argos", "en", "ru"), ("argos", "ru", "en"), ("argos", "zh", "en"), ("argos", "en", "zh"), ("argos", "de", "en"), ("argos", "en", "es"), ("argos", "fr", "de")]
MULTI = ("en", "ru", "zh", "de", "fr", "es")


def edges(spark: SparkSession) -> DataFrame:
    return constant(spark, EDGES, "backend string, source string, target string")


def capabilities(spark: SparkSession) -> DataFrame:
    """Direct and pivot pairs of the primary models, all ordered pairs of the multilingual one."""
    # a row for each ordered pair of languages at most: kept as a constant, so that plans don't walk the graph again
    rows = [(routing.PRIMARY, r.source, r.target, r.kind) for r in routing.paths(edges(spark)).collect()]
    rows += [(routing.QUALITY, a, b, "direct") for a in MULTI for b in MULTI if a != b]
    return constant(spark, rows, "backend string, source string, target string, kind string")


EDGE_SQL = "edges(backend, source, target) AS (VALUES " + ", ".join(str(e) for e in EDGES) + ")"
WALK_SQL = """walk(source, goal, node, path, hops) AS (
  SELECT a.source, g.target, a.target, [a.source, a.target], 1 FROM edges a JOIN (SELECT DISTINCT target FROM edges) g ON g.target <> a.source AND g.target <> a.target
  UNION ALL
  SELECT w.source, w.goal, x.target, list_append(w.path, x.target), w.hops + 1 FROM walk w JOIN edges x ON x.source = w.node
  WHERE w.node <> w.goal AND NOT list_contains(w.path, x.target)),
closure AS (SELECT source, target, 'direct' AS kind, [source, target] AS path FROM edges
  UNION ALL SELECT source, goal, 'pivot', first(path ORDER BY hops, path) FROM walk WHERE node = goal GROUP BY source, goal)"""
CAPS_SQL = f"""{EDGE_SQL}, {WALK_SQL},
langs(lang) AS (VALUES {", ".join(f"('{x}')" for x in MULTI)}),
caps AS (SELECT 'argos' AS backend, source, target, kind FROM closure UNION ALL SELECT 'm2m100', a.lang, b.lang, 'direct' FROM langs a, langs b WHERE a.lang <> b.lang),
profiles(profile, prefer_quality, allow_quality, auto_gpu, threads, beam_size, batch_tokens) AS (VALUES {", ".join(str(p).replace("True", "true").replace("False", "false") for p in routing.PROFILES)})"""
DECIDE_SQL = """ranked AS (
  SELECT r.*, p.prefer_quality, coalesce(p.allow_quality, false) AS allow_quality, (r.source, r.target) IN (('en','ru'), ('ru','en')) AS preferred, coalesce(c.have, []) AS have FROM asked r LEFT JOIN profiles p USING (profile)
  LEFT JOIN (SELECT source, target, list(backend || ':' || kind) AS have FROM caps GROUP BY 1, 2) c ON c.source = r.source AND c.target = r.target),
ordered AS (SELECT *, CASE WHEN source = target THEN [] ELSE list_filter(
    CASE WHEN (prefer_quality AND NOT preferred) OR (profile IN ('balanced','automatic','turbo') AND NOT preferred) THEN ['m2m100:direct','argos:direct','argos:pivot'] ELSE ['argos:direct','m2m100:direct','argos:pivot'] END,
    lambda x: list_contains(have, x) AND (x <> 'm2m100:direct' OR allow_quality)) END AS ord FROM ranked),
decided AS (SELECT *, CASE WHEN source = target THEN 'passthrough' ELSE split_part(ord[1], ':', 1) END AS backend,
  CASE WHEN source = target THEN 'none' ELSE split_part(ord[1], ':', 2) END AS kind FROM ordered)"""


def cleaned(c: str) -> F.Column:
    """Two small letters of a declared language, or null."""
    return F.when(F.lower(F.substring(F.col(c), 1, 2)).isin(*MULTI), F.lower(F.substring(F.col(c), 1, 2)))


CLEANED = "CASE WHEN lower(left({c}, 2)) IN (" + ", ".join(f"'{x}'" for x in MULTI) + ") THEN lower(left({c}, 2)) END"


@query(
    f"""WITH {CUTS.replace("RECURSIVE cuts", "RECURSIVE " + EDGE_SQL + ", " + WALK_SQL + ", cuts")},
{CAPS_SQL[CAPS_SQL.index("langs(lang)"):]},
asked AS (SELECT DISTINCT {CLEANED.format(c="lang")} AS source, target, 'balanced' AS profile FROM documents d JOIN (SELECT job_id, target FROM document_configs) c USING (job_id)),
{DECIDE_SQL}
SELECT d.lang, c.target, r.backend, r.kind, count(*) AS segments, sum(length(s.seg_text)) AS chars
FROM cuts s JOIN (SELECT doc_id, job_id, {CLEANED.format(c="lang")} AS lang FROM documents) d USING (doc_id) JOIN document_configs c USING (job_id)
LEFT JOIN decided r ON r.source = d.lang AND r.target = c.target
WHERE s.seg_ord >= 0 AND regexp_matches(s.seg_text, '\\p{{L}}') GROUP BY ALL"""
)
def segment_route(spark: SparkSession, d: str) -> DataFrame:
    """Bounded segments with letters, counted by their document's language, their job's target and the route."""
    docs = read(spark, d, "documents", "doc_id", "text", "lang", "job_id").withColumn("lang", cleaned("lang"))
    jobs = read(spark, d, "document_configs", "job_id", "target")
    segs = segments.bounded(docs, "text", "doc_id", "lang", "job_id").where(T.has_letter(F.col("seg_text")))
    counts = segs.groupBy("lang", "job_id").agg(F.count("*").alias("segments"), F.sum(F.length("seg_text")).alias("chars")).join(jobs, "job_id").groupBy("lang", "target").agg(F.sum("segments").alias("segments"), F.sum("chars").alias("chars"))
    # every known language with every job's target: few rows, and the segments needn't be read again to learn which pairs occur
    asked = jobs.select("target").distinct().select(F.explode(F.array(*map(F.lit, MULTI))).alias("source"), "target", F.lit("balanced").alias("profile"))
    routes = routing.decide(asked, capabilities(spark), routing.profiles(spark)).select(F.col("source").alias("lang"), "target", "backend", "kind")
    return counts.join(routes, ["lang", "target"], "left").select("lang", "target", "backend", "kind", "segments", "chars")


@query(
    f"""SELECT request_id, received_at, CASE WHEN length(regexp_replace(text, '{WS}', '', 'g')) = 0 THEN 'blank' WHEN source_language = target_language THEN 'same_language'
  WHEN length(text) > 50000 THEN 'too_long' WHEN NOT regexp_matches(text, '\\p{{L}}') THEN 'no_letters' ELSE 'ok' END AS status, length(text) AS chars FROM requests"""
)
def request_guards(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "requests", "request_id", "received_at", "text", "source_language", "target_language")
    t = F.col("text")
    status = F.when(T.is_blank(t), "blank").when(F.col("source_language") == F.col("target_language"), "same_language").when(F.length(t) > T.MAX_TEXT, "too_long").when(~T.has_letter(t), "no_letters").otherwise("ok")
    return r.select("request_id", "received_at", status.alias("status"), F.length(t).alias("chars"))


@query(f"WITH {CUTS} SELECT doc_id, seg_ord, seg_text, regexp_matches(seg_text, '\\p{{L}}') AS translatable FROM cuts WHERE seg_ord >= 0")
def seg_bounded(spark: SparkSession, d: str) -> DataFrame:
    return segments.translatable(segments.bounded(read(spark, d, "documents", "doc_id", "text"), "text", "doc_id"))


@query(
    f"""WITH parts AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '\\r\\n|\\r|\\n|[^\\r\\n]+'), lambda x: x <> '')) AS item, generate_subscripts(list_filter(regexp_extract_all(text, '\\r\\n|\\r|\\n|[^\\r\\n]+'), lambda x: x <> ''), 1) - 1 AS line_ord FROM documents)
SELECT doc_id, line_ord, CASE WHEN b THEN 'layout' ELSE 'text' END AS kind, CASE WHEN b THEN item ELSE regexp_extract(item, '^{WS}*') END AS lead,
  CASE WHEN b THEN '' ELSE regexp_replace(regexp_replace(item, '^{WS}+', ''), '{WS}+\\z', '') END AS core, CASE WHEN b THEN '' ELSE regexp_extract(item, '{WS}*\\z') END AS tail
FROM (SELECT *, length(regexp_replace(item, '{WS}', '', 'g')) = 0 AS b FROM parts)"""
)
def seg_lines(spark: SparkSession, d: str) -> DataFrame:
    return segments.lines(read(spark, d, "documents", "doc_id", "text"), "text", "doc_id")


ADDRESS_SQL = T.ADDRESS


@query(f"SELECT segment_id, ord, address FROM (SELECT segment_id, unnest(a) AS address, generate_subscripts(a, 1) - 1 AS ord FROM (SELECT segment_id, regexp_extract_all(text, '{ADDRESS_SQL}') AS a FROM segments))")
def protected_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "segments", "segment_id", "text").select("segment_id", F.posexplode(T.addresses(F.col("text"))).alias("ord", "address"))


@query(
    """WITH g AS (SELECT job_id, doc_id, text, row_number() OVER (PARTITION BY job_id ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY job_id) AS n FROM documents WHERE text IS NOT NULL)
SELECT job_id, doc_id, left(text, 320) AS sample FROM g WHERE k IN (SELECT round_even(i * (n - 1) / greatest(1, least(n, 24) - 1)::DOUBLE, 0)::INT FROM range(0, 24) t(i) WHERE i < least(n, 24))"""
)
def doc_sample(spark: SparkSession, d: str) -> DataFrame:
    """Up to 24 documents of each job, evenly spread, each cut to 320 characters: a sampling operator."""
    docs = read(spark, d, "documents", "job_id", "doc_id", "text").where("text is not null")
    ranked = ordered.running(docs.select("job_id", "doc_id", F.lit(1).cast("bigint").alias("one")), ["job_id"], ["doc_id"], "one")
    hit = ranked.where(F.array_contains(segments.evenly(F.col("total"), 24), F.col("below").cast("int"))).select("doc_id")
    return docs.join(hit, "doc_id").select("job_id", "doc_id", F.substring("text", 1, 320).alias("sample"))


TOKENS = f"SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')) AS token FROM documents"


def tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("token", F.explode(F.filter(F.split("text", f"{WS}+"), lambda x: x != ""))).drop("text")


@query(rf"SELECT CASE WHEN regexp_matches(token, '^[а-яёА-ЯЁ\x{{301}}]+\z') THEN 'ru' WHEN regexp_matches(token, '^[a-zA-Z''’]+\z') THEN 'en' ELSE 'auto' END AS lang, count(*) AS n FROM ({TOKENS}) GROUP BY 1")
def script_guess(spark: SparkSession, d: str) -> DataFrame:
    return tokens(read(spark, d, "documents", "text")).groupBy(T.script_guess(F.col("token")).alias("lang")).agg(F.count("*").alias("n"))


@query(
    f"SELECT entry_id, regexp_replace(regexp_replace(replace(replace(lower(replace(nfc_normalize(h), '́', '')), 'ß', 'ss'), 'ς', 'σ'), '^{WS}+', ''), '{WS}+\\z', '') AS key FROM (SELECT entry_id, json_extract_string(payload, '$.headword') AS h FROM entries)"
)
def lookup_key(spark: SparkSession, d: str) -> DataFrame:
    h = F.get_json_object("payload", "$.headword")
    return read(spark, d, "entries", "entry_id", "payload").select("entry_id", T.lookup_key(h).alias("key"))


FREQ = "SELECT {c} AS lang, word, count(*) AS freq FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents) WHERE {c} IS NOT NULL GROUP BY 1, 2".format(c=CLEANED.format(c="lang"))


def frequencies(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.word_frequencies(read(spark, d, "documents", "text", "lang").withColumn("lang", cleaned("lang")), "text", "lang")


@query(FREQ)
def word_freq(spark: SparkSession, d: str) -> DataFrame:
    return frequencies(spark, d)


# What is typed: each frequent word without its last letter, with two letters swapped, and with a letter doubled away.
TYPED_LANGS = ("en", "ru", "de", "fr", "es")


def typed(freqs: DataFrame) -> DataFrame:
    w = F.col("word")
    some = freqs.where((F.length(w) >= 5) & (F.col("freq") >= 20) & F.col("lang").isin(*TYPED_LANGS))
    cut = w.substr(F.lit(1), F.length(w) - 1)
    swap = F.concat(w.substr(F.lit(1), F.lit(2)), w.substr(F.lit(4), F.lit(1)), w.substr(F.lit(3), F.lit(1)), w.substr(F.lit(5), F.length(w)))
    lost = F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.lit(1)), w.substr(F.lit(4), F.length(w)))
    return some.select("lang", F.explode(F.array(cut, swap, lost)).alias("typed")).distinct()


TYPED = f"""freqs AS ({FREQ}), typed AS (SELECT DISTINCT lang, unnest([left(word, length(word) - 1), left(word, 2) || substr(word, 4, 1) || substr(word, 3, 1) || substr(word, 5), upper(left(word, 1)) || substr(word, 2, 1) || substr(word, 4)]) AS typed
  FROM freqs WHERE length(word) >= 5 AND freq >= 20 AND lang IN ('en','ru','de','fr','es'))"""
COMPLETE = """complete AS (SELECT * FROM (SELECT a.lang, a.key, f.word, f.freq, row_number() OVER (PARTITION BY a.lang, a.key ORDER BY f.freq DESC, length(f.word), f.word) AS rank
  FROM keys a JOIN freqs f ON f.lang = a.lang AND starts_with(f.word, a.key) AND f.word <> a.key WHERE length(a.key) >= 3) WHERE rank <= 3)"""
# Osa distance 1: one edit, or one swap of neighbours.
CORRECT = """correct AS (SELECT a.lang, a.key, f.word, f.freq FROM keys a JOIN freqs f ON f.lang = a.lang AND abs(length(f.word) - length(a.key)) <= 1 AND f.word <> a.key
  WHERE (length(f.word) = length(a.key) AND (len(list_filter(range(1, length(a.key) + 1), lambda i: left(a.key, i - 1) = left(f.word, i - 1) AND substr(a.key, i + 1) = substr(f.word, i + 1))) > 0
      OR len(list_filter(range(1, length(a.key)), lambda i: left(a.key, i - 1) || substr(a.key, i + 1, 1) || substr(a.key, i, 1) || substr(a.key, i + 2) = f.word)) > 0))
    OR (length(f.word) = length(a.key) + 1 AND len(list_filter(range(1, length(f.word) + 1), lambda i: left(f.word, i - 1) || substr(f.word, i + 1) = a.key)) > 0)
    OR (length(f.word) + 1 = length(a.key) AND len(list_filter(range(1, length(a.key) + 1), lambda i: left(a.key, i - 1) || substr(a.key, i + 1) = f.word)) > 0))"""


@query(f"WITH {TYPED}, keys AS (SELECT DISTINCT lang, lower(typed) AS key FROM typed), {COMPLETE} SELECT lang, key, word, freq, rank FROM complete")
def prefix_complete(spark: SparkSession, d: str) -> DataFrame:
    f = frequencies(spark, d)
    return lexicon.completions(typed(f).select("lang", F.lower("typed").alias("key")), f)


@query(f"WITH {TYPED}, keys AS (SELECT DISTINCT lang, lower(typed) AS key FROM typed), {CORRECT} SELECT lang, key, word, freq FROM correct")
def spell_candidates(spark: SparkSession, d: str) -> DataFrame:
    f = frequencies(spark, d)
    return lexicon.corrections(typed(f).select("lang", F.lower("typed").alias("key")), f)


@query(
    f"""WITH {TYPED}, q AS (SELECT DISTINCT t.lang, t.typed, lower(t.typed) AS key FROM typed t LEFT JOIN freqs f ON f.lang = t.lang AND f.word = lower(t.typed)
  WHERE length(t.typed) BETWEEN 3 AND 32 AND regexp_matches(t.typed, '^\\p{{L}}+\\z') AND (t.lang = 'ru') = regexp_matches(t.typed, '^[а-яёА-ЯЁ]+\\z') AND coalesce(f.freq, 0) < 100),
keys AS (SELECT DISTINCT lang, key FROM q), {COMPLETE}, {CORRECT},
both_ AS (SELECT lang, key, word, freq, 'completion' AS kind FROM complete UNION ALL SELECT lang, key, word, freq, 'spelling' FROM correct),
pri AS (SELECT *, CASE WHEN len(list_filter(range(1, length(key) + 1), lambda i: left(key, i) || substr(key, i) = word)) > 0 THEN 0 WHEN kind = 'completion' AND freq >= 100 THEN 1 WHEN kind = 'spelling' THEN 2 ELSE 3 END AS priority FROM both_),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, key, word ORDER BY priority, kind) AS n FROM pri) WHERE n = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY priority, freq DESC, word) AS rank FROM one) WHERE rank <= 5)
SELECT q.lang, q.typed, CASE WHEN q.typed = upper(q.typed) THEN upper(word) WHEN left(q.typed, 1) = upper(left(q.typed, 1)) THEN upper(left(word, 1)) || lower(substr(word, 2)) ELSE word END AS word, kind, rank
FROM q JOIN best b ON b.lang = q.lang AND b.key = q.key"""
)
def suggest(spark: SparkSession, d: str) -> DataFrame:
    f = frequencies(spark, d)
    return lexicon.suggestions(typed(f), f, known=100)


@query(
    """SELECT a.source, a.target, a.key, e.ord, e.entry_id, e.headword FROM (SELECT DISTINCT source, target, k AS key FROM (SELECT source, target, unnest([lower(key), key, key || 's']) AS k FROM entries)) a
LEFT JOIN (SELECT * FROM (SELECT source, target, key, entry_id, row_number() OVER (PARTITION BY source, target, key ORDER BY entry_id) AS ord, json_extract_string(payload, '$.headword') AS headword FROM entries) WHERE ord <= 12) e USING (source, target, key)"""
)
def lexicon_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "entries")
    asked = e.select("source", "target", F.explode(F.array(F.lower("key"), F.col("key"), F.concat("key", F.lit("s")))).alias("key")).distinct()
    return lexicon.lookup(asked, e).select("source", "target", "key", "ord", "entry_id", F.col("p.headword").alias("headword"))


@query("SELECT entry_id, len(list_filter(from_json(payload->'senses', '[\"JSON\"]')[1:10], lambda s: true)) AS senses, json_extract_string(payload, '$.senses[0].translations[0]') AS first_translation FROM entries")
def lexicon_shown(spark: SparkSession, d: str) -> DataFrame:
    p = lexicon.shown(F.from_json("payload", lexicon.PAYLOAD))
    return read(spark, d, "entries", "entry_id", "payload").select("entry_id", F.size(p["senses"]).cast("bigint").alias("senses"), F.get(F.get(p["senses"], F.lit(0))["translations"], F.lit(0)).alias("first_translation"))


TEI = "<entry xmlns='http://www.tei-c.org/ns/1.0'><form><orth>{h}</orth><pron>/{h}/</pron></form><gramGrp><pos>n</pos></gramGrp><sense><cit type='trans'><quote>{t}</quote></cit><def>{t}</def></sense><sense><def>x</def></sense></entry>"


@query(
    r"""SELECT 'en' AS source, 'ru' AS target, regexp_replace(regexp_replace(replace(replace(lower(replace(nfc_normalize(trim(h)), 'x́x', '')), 'ß', 'ss'), 'ς', 'σ'), '^\s+', ''), '\s+\z', '') AS key, trim(h) AS headword, trim(t) AS translation
FROM (SELECT json_extract_string(payload, '$.headword') AS h, json_extract_string(payload, '$.senses[0].translations[0]') AS t FROM entries) WHERE h IS NOT NULL AND t IS NOT NULL AND trim(h) <> '' AND trim(t) <> ''""".replace("x́x", "́")
)
def tei_import(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon written as TEI entries and read again."""
    e = read(spark, d, "entries", "payload").select(F.get_json_object("payload", "$.headword").alias("h"), F.get_json_object("payload", "$.senses[0].translations[0]").alias("t"))
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("'"), F.lit("&apos;"))
    xml = F.replace(F.replace(F.lit(TEI), F.lit("{h}"), esc("h")), F.lit("{t}"), esc("t"))
    got = lexicon.tei_entries(e.where("h is not null and t is not null").select(xml.alias("xml")), "xml", "en", "ru")
    p = F.from_json("payload", lexicon.PAYLOAD)
    return got.select("source", "target", "key", p["headword"].alias("headword"), p["senses"][0]["translations"][0].alias("translation"))


@query(f"WITH RECURSIVE {EDGE_SQL}, {WALK_SQL} SELECT source, target, kind, array_to_string(path, '>') AS path FROM closure")
def capability_closure(spark: SparkSession, d: str) -> DataFrame:
    return routing.paths(edges(spark)).withColumn("path", F.array_join("path", ">"))


@query(
    f"""WITH RECURSIVE {CAPS_SQL}, asked AS (SELECT DISTINCT {CLEANED.format(c="source_language")} AS source, target_language AS target, performance_profile AS profile FROM requests WHERE {CLEANED.format(c="source_language")} IS NOT NULL), {DECIDE_SQL}
SELECT source, target, profile, backend, kind, CASE WHEN source = target THEN 'source equals target' WHEN len(ord) > 0 THEN kind || CASE WHEN backend = 'm2m100' THEN ' quality' ELSE ' primary' END || ' route for ' || source || '-' || target END AS reason,
  array_to_string(ord[2:], ',') AS fallbacks, CASE WHEN source <> target AND len(ord) = 0 THEN 'unsupported_language' END AS error FROM decided"""
)
def route_decision(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "requests").select(cleaned("source_language").alias("source"), F.col("target_language").alias("target"), F.col("performance_profile").alias("profile")).where("source is not null").distinct()
    return routing.decide(asked, capabilities(spark), routing.profiles(spark))


@query(
    f"""WITH profiles(profile, prefer_quality, allow_quality, auto_gpu, threads, beam_size, batch_tokens) AS (VALUES {", ".join(str(p).replace("True", "true").replace("False", "false") for p in routing.PROFILES)}),
r AS (SELECT DISTINCT device_preference AS preference, performance_profile AS profile, cpu_threads FROM requests), g(gpu) AS (VALUES (true), (false))
SELECT preference, profile, cpu_threads, gpu, array_to_string(CASE preference WHEN 'cpu' THEN ['cpu'] WHEN 'gpu' THEN CASE WHEN gpu THEN ['cuda'] ELSE [] END ELSE CASE WHEN gpu AND auto_gpu THEN ['cuda','cpu'] ELSE ['cpu'] END END, ',') AS devices,
  greatest(1, least(8, coalesce(cpu_threads, threads))) AS threads FROM r JOIN profiles USING (profile) CROSS JOIN g"""
)
def device_plan(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "requests").select(F.col("device_preference").alias("preference"), F.col("performance_profile").alias("profile"), "cpu_threads").distinct()
    both = r.join(F.broadcast(routing.profiles(spark)), "profile").withColumn("gpu", F.explode(F.array(F.lit(True), F.lit(False))))
    dev = routing.devices(F.col("preference"), F.col("auto_gpu"), F.array(F.lit("cpu"), F.lit("cuda")), F.col("gpu"))
    return both.select("preference", "profile", "cpu_threads", "gpu", F.array_join(dev, ",").alias("devices"), routing.threads(F.col("cpu_threads"), F.col("threads"), 8).alias("threads"))


@query("SELECT options_id, array_to_string(list_filter(CASE WHEN device = 'cuda' THEN ['int8_float16','int8_float32','float32'] ELSE ['int8','int8_float32','float32'] END, lambda x: x IN ('int8','float32','int8_float16')), ',') AS types FROM inference_options")
def compute_plan(spark: SparkSession, d: str) -> DataFrame:
    have = F.array(F.lit("int8"), F.lit("float32"), F.lit("int8_float16"))
    return read(spark, d, "inference_options").select("options_id", F.array_join(routing.compute_types(F.col("device"), have), ",").alias("types"))


@query(
    """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o, event_type = 'purchase' AS ok FROM events),
g AS (SELECT user_id, min(CASE WHEN ok THEN o END) AS winner FROM a GROUP BY 1)
SELECT user_id, winner, count(*) FILTER (winner IS NULL OR o <= winner) AS tries, coalesce(winner > 1, false) AS fallback_used FROM a JOIN g USING (user_id) GROUP BY ALL"""
)
def fallback_attempts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events", "user_id", "event_id", "ts", "event_type").withColumn("one", F.lit(1).cast("bigint"))
    a = ordered.running(e, ["user_id"], ["ts", "event_id"], "one").select("user_id", (F.col("below") + 1).alias("o"), (F.col("event_type") == "purchase").alias("ok"))
    return routing.first_success(a, "user_id", "o", "ok")


GOOD = "duration_ms IS NOT NULL AND NOT isnan(duration_ms) AND duration_ms >= 0"


@query(f"SELECT backend, device, count(*) AS n, count(*) FILTER (NOT coalesce({GOOD}, false)) AS errors, round(quantile_cont(duration_ms, 0.5) FILTER ({GOOD}), 6) AS median_ms, round(quantile_disc(duration_ms, 0.95) FILTER ({GOOD}), 6) AS p95_ms, round(max(duration_ms) FILTER ({GOOD}), 6) AS worst_ms FROM results GROUP BY 1, 2")
def attempt_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.attempt_metrics(read(spark, d, "results", "backend", "device", "duration_ms"), ["backend", "device"], "duration_ms", F.col("duration_ms") >= 0)


@query(
    f"""WITH g AS (SELECT target_language, round(median(duration_ms), 6) AS median_ms, sum(length(translated_text)) AS chars,
  CASE WHEN target_language IN ('zh', 'ja') THEN NULL ELSE sum(len(list_filter(regexp_split_to_array(translated_text, '{WS}+'), lambda x: x <> ''))) END AS words
FROM results WHERE translated_text IS NOT NULL AND {GOOD} GROUP BY 1)
SELECT *, CASE WHEN median_ms > 0 THEN round(chars * 1000 / median_ms, 3) END AS chars_per_s, CASE WHEN median_ms > 0 AND words > 0 THEN round(words * 1000 / median_ms, 3) END AS words_per_s FROM g"""
)
def throughput(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "results", "translated_text", "target_language", "duration_ms").where("translated_text is not null and duration_ms is not null and not isnan(duration_ms) and duration_ms >= 0")
    g = r.groupBy("target_language").agg(F.round(F.median("duration_ms"), 6).alias("median_ms"), F.sum(F.length("translated_text")).alias("chars"), F.sum(T.word_count(F.col("translated_text"), F.col("target_language"))).alias("words"))
    chars, words = metrics.throughput(F.col("median_ms"), F.col("chars"), F.col("words"))
    return g.select("*", chars.alias("chars_per_s"), words.alias("words_per_s"))


@query("WITH p(profile) AS (VALUES ('economy'),('fast'),('balanced'),('turbo'),('maximum'),('automatic')), b(backend) AS (VALUES ('argos'),('m2m100')), d(device) AS (VALUES ('cpu'),('cuda')) SELECT profile, backend, device, id AS case_id, length(text) AS chars FROM benchmark_corpus, p, b, d")
def bench_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark case with every profile, backend and device: the grid is the result, its sides but the cases are constants."""
    grid = F.array(*[F.struct(F.lit(p[0]).alias("profile"), F.lit(b).alias("backend"), F.lit(v).alias("device")) for p in routing.PROFILES for b in (routing.PRIMARY, routing.QUALITY) for v in ("cpu", "cuda")])
    return read(spark, d, "benchmark_corpus", "id", "text").select(F.explode(grid).alias("g"), F.col("id").alias("case_id"), F.length("text").alias("chars")).select("g.profile", "g.backend", "g.device", "case_id", "chars")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def last_attempts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events", "event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)


CONCEPTS = (("glossary", "глоссар", "glosario", "glossaire"), ("memory", "памят", "memoria", "mémoire"), ("page", "страниц", "página"))


@query("SELECT case_no, " + " + ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{a}')" for a in alts) + " THEN 1 ELSE 0 END" for alts in CONCEPTS) + " AS score FROM benchmark_corpus")
def concept_score(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "benchmark_corpus", "case_no", "text").withColumn("concepts", F.array(*[F.array(*map(F.lit, alts)) for alts in CONCEPTS]))
    return rows.select("case_no", metrics.concept_score(rows, "text", "concepts").alias("score"))


SESSIONS = "s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"


@query(f"WITH {SESSIONS} SELECT user_id, max(ts) AS fired_at, last(event_id ORDER BY ts, event_id) AS event_id, count(*) AS edits FROM s GROUP BY user_id, island")
def debounce(spark: SparkSession, d: str) -> DataFrame:
    return timers.debounce(read(spark, d, "events", "user_id", "ts", "event_id"), "user_id", "ts", "event_id", 30 * 60_000).withColumnRenamed("value", "event_id")


@query("SELECT request_id, received_at, target_language, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY received_at DESC, created_at DESC, text DESC, target_language DESC) AS n FROM requests) WHERE n = 1")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "requests", "request_id", "received_at", "created_at", "text", "target_language").withColumn("chars", F.length("text"))
    return timers.latest(r, "request_id", "received_at", "created_at", "text", "target_language").select("request_id", "received_at", "target_language", "chars")


@query("SELECT user_id, sum(b) AS loads, count(*) AS uses FROM (SELECT user_id, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type OR ts - lag(ts) OVER w >= INTERVAL 180 SECOND THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1")
def warm_loads(spark: SparkSession, d: str) -> DataFrame:
    return timers.warm_periods(read(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", "event_type", 180)


@query("SELECT user_id, coalesce(sum(CASE WHEN event_type <> 'error' THEN epoch_us(nx) - epoch_us(ts) END), 0) / 1000000 AS active_s FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) GROUP BY 1")
def active_time(spark: SparkSession, d: str) -> DataFrame:
    return timers.active_seconds(read(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", F.col("event_type") != "error")


ALLOWED = [("signup", "view"), ("view", "click"), ("click", "view"), ("click", "purchase"), ("view", "view"), ("purchase", "view"), ("error", "view")]


@query("WITH t(b, a) AS (VALUES " + ", ".join(str(x) for x in ALLOWED) + ") SELECT before, event_type, before IS NULL OR (before, event_type) IN (SELECT (b, a) FROM t) AS valid, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY ALL")
def transitions(spark: SparkSession, d: str) -> DataFrame:
    allowed = constant(spark, ALLOWED, "before string, after string")
    e = timers.transitions(read(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", "event_type", allowed)
    return e.groupBy("before", "event_type", "valid").agg(F.count("*").alias("n"))


@query("SELECT event_id, load, load <= 1 AS admitted FROM (SELECT event_id, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS load FROM events)")
def admission(spark: SparkSession, d: str) -> DataFrame:
    change = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    return timers.running_load(read(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", change, 1).select("event_id", "load", "admitted")


@query("SELECT segment_id, done, total, CASE WHEN done = total THEN 100 ELSE least(99, floor(done * 100 / total)) END::INT AS percent, round_even(done * 2.5 * (total - done) / done, 0)::BIGINT AS eta_s FROM (SELECT segment_id, row_number() OVER (PARTITION BY doc_id ORDER BY segment_id) AS done, count(*) OVER (PARTITION BY doc_id) AS total FROM segments)")
def progress(spark: SparkSession, d: str) -> DataFrame:
    p = timers.progress(read(spark, d, "segments", "doc_id", "segment_id"), "doc_id", ["segment_id"], F.col("done") * 2.5)
    return p.select("segment_id", "done", "total", "percent", "eta_s")


@query(
    r"""WITH f AS (SELECT doc_id, d.job_id, regexp_replace(file_name, '\.[^.]*\z', '') AS stem, regexp_extract(file_name, '\.[^.]*\z') AS ext, replace(replace(c.template, '{name}', regexp_replace(file_name, '\.[^.]*\z', '')), '{lang}', c.target) AS base FROM documents d JOIN document_configs c USING (job_id))
SELECT doc_id, base || CASE WHEN n > 1 THEN ' (' || (n - 1) || ')' ELSE '' END || ext AS final_name FROM (SELECT *, row_number() OVER (PARTITION BY job_id, base, ext ORDER BY doc_id) AS n FROM f)"""
)
def collision_names(spark: SparkSession, d: str) -> DataFrame:
    docs, jobs = read(spark, d, "documents", "doc_id", "job_id", "file_name"), read(spark, d, "document_configs", "job_id", "template", "target")
    f = docs.join(jobs, "job_id").withColumn("base", T.expand_template(F.col("template"), T.stem(F.col("file_name")), F.col("target"))).withColumn("ext", T.suffix(F.col("file_name")))
    return corpus.numbered(f, "job_id", "base", F.col("ext"), "doc_id").select("doc_id", "final_name")


@query(
    r"""WITH s AS (SELECT segment_id, text, left(regexp_replace(regexp_replace(regexp_replace(text, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[ .]+', ''), '[ .]+\z', ''), 120) AS a,
  left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^[\t-\r\x{85}\p{Z}]+', ''), '[\t-\r\x{85}\p{Z}]+\z', ''), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '[ .]+\z', ''), 120) AS b FROM segments)
SELECT segment_id, CASE WHEN a = '' OR regexp_matches(a, '^(?i:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\.|\z)') THEN '_' || a ELSE a END AS name, CASE WHEN b <> '' AND NOT regexp_matches(b, '^(?i:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])\z') THEN b ELSE 'CON2' END AS base FROM s"""
)
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "segments", "segment_id", "text").select("segment_id", T.safe_name(t).alias("name"), T.safe_base(t, F.lit("CON2")).alias("base"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each text; texts are compared by their SHA-256."""
    docs = read(spark, d, "documents", "doc_id", "text")
    return corpus.first_of(docs.select("doc_id", F.sha2("text", 256).alias("h")), F.col("h"), [F.col("doc_id")]).select("doc_id")


@query(
    """WITH e AS (SELECT doc_id, n_chars AS size, sha256(rtrim(text, chr(10))) AS sha FROM documents), a AS (SELECT doc_id, length(text) AS size, sha256(text) AS sha FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN e.size IS DISTINCT FROM a.size THEN 'size' WHEN e.sha IS DISTINCT FROM a.sha THEN 'hash' ELSE 'ok' END AS state FROM e LEFT JOIN a USING (doc_id)"""
)
def integrity(spark: SparkSession, d: str) -> DataFrame:
    """Declared sizes, and hashes of the texts without last line breaks, against the texts that are there."""
    docs = read(spark, d, "documents", "doc_id", "text", "n_chars")
    declared = docs.select("doc_id", F.col("n_chars").cast("int").alias("size"), F.sha2(F.regexp_replace("text", r"\n+\z", ""), 256).alias("sha"))
    return corpus.differences(declared, docs.where("text is not null").select("doc_id", F.length("text").alias("size"), F.sha2("text", 256).alias("sha")), "doc_id")


@query(
    """WITH p AS (SELECT job_id, coalesce(source, 'none') AS s, lang IS NOT NULL AS sel FROM documents), f AS (SELECT unnest(['', job_id, job_id || '/' || s]) AS folder, sel FROM p), dirs AS (SELECT DISTINCT unnest([job_id, job_id || '/' || s]) AS dir FROM p),
b AS (SELECT unnest(CASE WHEN contains(dir, '/') THEN ['', split_part(dir, '/', 1)] ELSE [''] END) AS folder FROM dirs), c AS (SELECT folder, count(*) AS folders FROM b GROUP BY 1)
SELECT f.folder, count(*) AS files, coalesce(any_value(c.folders), 0) AS folders, CASE WHEN bool_and(sel) THEN 'all' WHEN NOT bool_or(sel) THEN 'none' ELSE 'partial' END AS state FROM f LEFT JOIN c USING (folder) GROUP BY 1"""
)
def tree_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents", "job_id", "source", "lang", "file_name", "doc_id")
    path = F.concat_ws("/", "job_id", F.coalesce("source", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit("_"), "file_name"))
    return corpus.tree_counts(docs.select(path.alias("path"), F.col("lang").isNotNull().alias("sel")), "path", "sel")


@query(
    f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (i // 192)::INT AS chunk_ord, len(a[i + 1:i + 192]) AS n, a[i + 1] AS first_token FROM (SELECT doc_id, a, unnest(range(0, len(a), 192)) AS i FROM t WHERE len(a) > 0)"""
)
def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents", "doc_id", "text").select("doc_id", F.filter(F.split("text", f"{WS}+"), lambda x: x != "").alias("a"))
    return segments.chunks(t, "a", "doc_id", size=192).select("doc_id", "chunk_ord", F.size("tokens").alias("n"), F.col("tokens")[0].alias("first_token"))


@query(
    """WITH RECURSIVE s AS (SELECT doc_id, segment_id, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY segment_id) AS k FROM segments WHERE text IS NOT NULL),
p(doc_id, segment_id, k, batch, total) AS (SELECT doc_id, segment_id, k, 0, n FROM s WHERE k = 1 UNION ALL
  SELECT s.doc_id, s.segment_id, s.k, CASE WHEN p.total + s.n <= 768 THEN p.batch ELSE p.batch + 1 END, CASE WHEN p.total + s.n <= 768 THEN p.total + s.n ELSE s.n END FROM p JOIN s ON s.doc_id = p.doc_id AND s.k = p.k + 1)
SELECT doc_id, segment_id, batch FROM p"""
)
def token_batches(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "segments", "doc_id", "segment_id", "text").where("text is not null").select("doc_id", "segment_id", F.length("text").alias("n"))
    return segments.batches(s, "doc_id", "segment_id", "n", 768)


@query(f"WITH parts AS ({SQL['seg_lines']}) SELECT doc_id, string_agg(lead || replace(core, 'e', '3') || tail, '' ORDER BY line_ord) AS text FROM parts GROUP BY doc_id")
def reassemble(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into lines, their cores changed, and put together again."""
    parts = segments.lines(read(spark, d, "documents", "doc_id", "text"), "text", "doc_id").withColumn("core", F.replace("core", F.lit("e"), F.lit("3")))
    return segments.reassemble(parts, "doc_id", "line_ord", F.lit("en"))


SPAN_PLACES = f"""s AS (SELECT segment_id, translated AS t, string_split(translated, '') AS c, length(translated) AS n, length(text) AS m, length(text) // 2 AS a, length(text) // 4 AS b FROM segments WHERE translated IS NOT NULL AND text IS NOT NULL AND translated <> ''),
p AS (SELECT *, list_filter(range(1, n + 1), lambda i: i = n OR (regexp_matches(c[i], '{WS}') AND NOT regexp_matches(c[i + 1], '{WS}'))) AS ends, regexp_matches(t, '{WS}') AS blank,
  round_even(n * a / greatest(1, m)::DOUBLE, 0)::BIGINT AS w1, round_even(n * (a + b) / greatest(1, m)::DOUBLE, 0)::BIGINT AS w2 FROM s),
q AS (SELECT segment_id, t, n, CASE WHEN blank THEN list_sort(list_transform(list_prepend(0, ends), lambda e: {{'d': abs(e - w1), 'e': e}}))[1].e ELSE w1 END AS x, CASE WHEN blank THEN list_sort(list_transform(list_prepend(0, ends), lambda e: {{'d': abs(e - w2), 'e': e}}))[1].e ELSE w2 END AS y FROM p)"""


@query(
    f"""WITH {SPAN_PLACES} SELECT segment_id, 0 AS span_ord, left(t, x) AS span_text FROM q UNION ALL SELECT segment_id, 1, substr(t, x + 1, y - x) FROM q UNION ALL SELECT segment_id, 2, substr(t, y + 1) FROM q
UNION ALL SELECT segment_id, i, '' FROM segments, range(3) r(i) WHERE translated = '' AND text IS NOT NULL"""
)
def span_allocate(spark: SparkSession, d: str) -> DataFrame:
    """Each translated segment dealt out over three spans in the proportions of its source."""
    s = read(spark, d, "segments", "segment_id", "text", "translated").where("translated is not null and text is not null")
    n = F.length("text")
    s = s.select("segment_id", "translated", F.array(F.floor(n / 2).cast("int"), F.floor(n / 4).cast("int"), (n - F.floor(n / 2) - F.floor(n / 4)).cast("int")).alias("lengths"))
    return segments.reallocate(s, "segment_id", "translated", "lengths")


@query(
    """SELECT CASE WHEN source = 'ru' THEN upper(id) ELSE id END AS id, array_to_string(list_filter([CASE WHEN source = 'ru' THEN 'id' END, CASE WHEN source = 'zh' THEN 'no_files' END, CASE WHEN source = 'es' THEN 'sha' END,
  CASE WHEN n % 2 = 1 OR source = 'zh' AND total > 0 THEN 'size' END, CASE WHEN target = 'fr' AND source <> 'zh' THEN 'duplicate_file' END, CASE WHEN source = 'de' THEN 'pair' END, CASE WHEN target = 'en' THEN 'path' END], lambda x: x IS NOT NULL), ',') AS errors
FROM (SELECT source, target, lower(replace(source || '-' || target, ' ', '')) AS id, count(*) AS n, coalesce(sum(length(key)), 0) AS total FROM entries GROUP BY 1, 2)"""
)
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """A model record for each pair of languages, with what is wrong planted by language: ids, hashes, files, sizes, pairs and paths."""
    e = read(spark, d, "entries", "source", "target", "key")
    s, t = F.col("source"), F.col("target")
    g = e.groupBy("source", "target").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("total"))
    one = F.struct(F.lit("model.bin").alias("path"), F.col("total").cast("bigint").alias("size"), F.when(s == "es", "0").otherwise("0" * 64).alias("sha256"))
    other = F.struct(F.lit("model.bin").alias("path"), F.lit(0).cast("bigint").alias("size"), F.lit("0" * 64).alias("sha256"))
    kept = F.when(s == "zh", F.slice(F.array(one), 1, 0)).when(t == "fr", F.array(one, other)).otherwise(F.array(one))
    name = F.lower(F.replace(F.concat_ws("-", "source", "target"), F.lit(" "), F.lit("")))
    pair = F.when(s == "de", F.array("source", "target", "source")).otherwise(F.array("source", "target"))
    path = F.concat(F.when(t == "en", "../").otherwise("models/"), s)
    m = g.select(F.when(s == "ru", F.upper(name)).otherwise(name).alias("id"), path.alias("path"), F.array("source").alias("languages"), F.array(pair).alias("pairs"), kept.alias("files"), (F.col("total") + F.col("n") % 2).cast("bigint").alias("size"))
    return corpus.manifest_errors(m).select("id", F.array_join("errors", ",").alias("errors"))


@query(
    """WITH new AS (SELECT job_id, 'de' AS target, 99 AS threads FROM document_configs WHERE target = 'en') SELECT job_id, target, threads FROM document_configs WHERE job_id NOT IN (SELECT job_id FROM new) UNION ALL SELECT * FROM new"""
)
def upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "document_configs", "job_id", "target", "threads")
    return corpus.upsert(rows, rows.where("target = 'en'").select("job_id", F.lit("de").alias("target"), F.lit(99).alias("threads")), "job_id")


@query("SELECT DISTINCT x AS lang FROM (SELECT source AS x FROM entries UNION ALL SELECT target FROM entries) EXCEPT SELECT target FROM mix_targets_none".replace("EXCEPT SELECT target FROM mix_targets_none", "EXCEPT SELECT 'xx'"))
def language_set(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "entries", "source", "target")
    return e.select(F.explode(F.array("source", "target")).alias("lang")).distinct().where("lang <> 'xx'")


@query("SELECT case_no, id FROM benchmark_corpus WHERE source IN (SELECT DISTINCT source FROM entries) AND id NOT IN (SELECT id FROM benchmark_corpus WHERE version > 1)")
def case_selection(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose source language the lexicon has (semi-join), without those of later versions (anti-join)."""
    b, e = read(spark, d, "benchmark_corpus", "case_no", "id", "source", "version"), read(spark, d, "entries", "source")
    return b.join(e.distinct(), "source", "left_semi").join(b.where("version > 1").select("id"), "id", "left_anti").select("case_no", "id")


@query("SELECT result_id, printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) AS clock FROM (SELECT result_id, CASE WHEN isnan(duration_ms) OR isinf(duration_ms) OR duration_ms < 0 THEN NULL ELSE floor(duration_ms / 1000)::BIGINT END AS s FROM results)")
def clocks(spark: SparkSession, d: str) -> DataFrame:
    """How long every result took as HH:MM:SS; null where it isn't known."""
    ms = F.col("duration_ms")
    known = F.when(~F.isnan(ms) & (ms >= 0) & (ms < float("inf")), F.floor(ms / 1000))
    return read(spark, d, "results", "result_id", "duration_ms").select("result_id", T.clock(known).alias("clock"))


@query("SELECT segment_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html, trim(text, ' .,!?;:。！？\"“”()[]') AS term FROM segments")
def markup_terms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "segments", "segment_id", "text").select("segment_id", T.escape_markup(t).alias("html"), T.trim_punctuation(t).alias("term"))


@query("SELECT job_id, CASE source WHEN 'Определить автоматически' THEN 'auto' WHEN 'Авто' THEN 'auto' WHEN 'Русский' THEN 'ru' WHEN 'Английский' THEN 'en' WHEN 'Английский (США)' THEN 'en' WHEN 'Немецкий' THEN 'de' WHEN 'Испанский' THEN 'es' WHEN 'Французский' THEN 'fr' WHEN 'Китайский' THEN 'zh' WHEN 'Японский' THEN 'ja' ELSE lower(source) END AS code, coalesce(threads, 4) AS threads FROM document_configs")
def settings_defaults(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "document_configs", "job_id", "source", "threads").select("job_id", T.language_code(F.col("source")).alias("code"), F.coalesce("threads", F.lit(4)).alias("threads"))


@query("SELECT '| ' || backend || ' | ' || CASE WHEN device IS NULL THEN '—' ELSE device END || ' | ' || CASE WHEN m IS NULL THEN '—' ELSE printf('%.1f', m) END || ' |' AS line FROM (SELECT backend, device, round(quantile_disc(duration_ms, 0.95), 6) AS m FROM results WHERE duration_ms IS NOT NULL AND NOT isnan(duration_ms) AND duration_ms >= 0 GROUP BY 1, 2)")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "results", "backend", "device", "duration_ms").where("duration_ms is not null and not isnan(duration_ms) and duration_ms >= 0")
    m = metrics.attempt_metrics(r, ["backend", "device"], "duration_ms", F.lit(True))
    return metrics.markdown(m, {"backend": F.col("backend"), "device": F.coalesce("device", F.lit("—")), "p95": metrics.number(F.col("p95_ms"))})


class Changed(inference.WordDouble):
    """A test double that puts another sign for a letter. Not a translation."""

    def infer(self, chunks: list[list[str]]) -> list[list[str]]:
        return [[w.replace("e", "3") for w in c] for c in chunks]


@query("SELECT segment_id, replace(text, 'e', '3') AS translated, CAST(NULL AS VARCHAR) AS error FROM segments")
def translate_changed(spark: SparkSession, d: str) -> DataFrame:
    """All segments through lines, chunks, calls and reassembly with a model that changes a letter."""
    rows = read(spark, d, "segments", "segment_id", "text").withColumn("target", F.lit("ru"))
    return inference.translate(rows, "text", "target", Changed, inference.Limits(), "segment_id")


@query("SELECT segment_id, replace(replace(text, 'e', '3'), '3', '33') AS translated, 2 AS hops FROM segments WHERE regexp_matches(text, '\\p{L}') UNION ALL SELECT segment_id, text, 0 FROM segments WHERE text IS NULL OR NOT regexp_matches(text, '\\p{L}')")
def translate_pivot(spark: SparkSession, d: str) -> DataFrame:
    """All segments along a path of two hops, each with a model of its own pair."""

    def build(a: str, b: str, _: inference.Decoding) -> inference.Model:
        class Hop(inference.WordDouble):
            def infer(self, chunks: list[list[str]]) -> list[list[str]]:
                return [[w.replace("e", "3") if a == "en" else w.replace("3", "33") for w in c] for c in chunks]

        return Hop()

    rows = read(spark, d, "segments", "segment_id", "text").withColumn("path", F.array(F.lit("en"), F.lit("de"), F.lit("ru")))
    return inference.translate_along(rows, "text", "path", build, inference.Limits(), inference.Decoding(), "segment_id").select("segment_id", "translated", "hops")


OFFERED = {"argos": ("cpu", "cuda"), "m2m100": ("cpu", "cuda")}
FORMATS = {"cuda": ("int8_float16", "float32"), "cpu": ("int8", "float32")}


class Moody:
    """A test double of a runner: some backends, devices and formats fail for some lengths. Not a translation."""

    def __call__(self, backend: str, kind: str, device: str, compute: str, source: str, target: str, text: str) -> str:
        n = len(text)
        if n % 97 == 0:
            raise attempts.Cancelled
        if compute == "int8_float16" and n % 2 == 0:
            raise attempts.DeviceUnavailable
        if backend == "m2m100" and n % 3 == 0:
            raise ValueError
        return " " if kind == "pivot" and n % 5 == 0 else text


@query(
    f"""WITH RECURSIVE {CAPS_SQL}, asked AS (SELECT request_id, received_at, text, device_preference AS pref, {CLEANED.format(c="source_language")} AS source, target_language AS target, performance_profile AS profile FROM requests WHERE {CLEANED.format(c="source_language")} IS NOT NULL AND text IS NOT NULL), {DECIDE_SQL},
d AS (SELECT o.*, length(o.text) AS n, CASE o.pref WHEN 'cpu' THEN ['cpu'] WHEN 'gpu' THEN ['cuda'] ELSE CASE WHEN p.auto_gpu THEN ['cuda','cpu'] ELSE ['cpu'] END END AS devs FROM decided o LEFT JOIN profiles p USING (profile)),
e AS (SELECT *, flatten(list_transform(ord, lambda c: flatten(list_transform(devs, lambda v: list_transform(CASE WHEN v = 'cuda' THEN ['int8_float16','float32'] ELSE ['int8','float32'] END, lambda f: c || '|' || v || '|' || f))))) AS plan FROM d),
h AS (SELECT *, list_filter(plan, lambda x: NOT (ends_with(x, 'int8_float16') AND n % 2 = 0) AND NOT (starts_with(x, 'm2m100') AND n % 3 = 0) AND NOT (contains(x, ':pivot|') AND n % 5 = 0))[1] AS win, length(regexp_replace(text, '{WS}', '', 'g')) = 0 OR source = target AS still FROM e)
SELECT request_id, received_at, CASE WHEN n > 50000 THEN NULL WHEN still THEN 'passthrough' WHEN n % 97 = 0 THEN NULL ELSE split_part(win, ':', 1) END AS backend, CASE WHEN n > 50000 OR still OR n % 97 = 0 THEN NULL ELSE split_part(win, '|', 2) END AS device,
  CASE WHEN n > 50000 OR still OR n % 97 = 0 THEN NULL ELSE split_part(win, '|', 3) END AS compute,
  CASE WHEN n > 50000 THEN 'long' WHEN still THEN 'passthrough' WHEN n % 97 = 0 AND len(plan) > 0 THEN 'cancelled' WHEN win IS NULL THEN 'failed' WHEN win = plan[1] THEN 'first' ELSE 'fallback' END AS outcome FROM h"""
)
def attempt_run(spark: SparkSession, d: str) -> DataFrame:
    """Every request's route carried out with a runner that fails for some: who answered, and whether by a fallback."""
    r = read(spark, d, "requests", "request_id", "received_at", "text", "device_preference", "source_language", "target_language", "performance_profile").where("text is not null")
    r = r.select("request_id", "received_at", "text", F.col("device_preference").alias("preference"), cleaned("source_language").alias("source"), F.col("target_language").alias("target"), F.col("performance_profile").alias("profile")).where("source is not null")
    decided = routing.decide(r, capabilities(spark), routing.profiles(spark)).join(F.broadcast(routing.profiles(spark).select("profile", "auto_gpu")), "profile", "left")  # one row per profile
    candidates = F.when(F.col("kind").isNull() | (F.col("backend") == "passthrough"), F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat_ws(":", "backend", "kind")), F.filter(F.split("fallbacks", ","), lambda x: x != "")))
    plan = attempts.planned(F.col("preference"), F.col("auto_gpu"), candidates, {k: F.array(*map(F.lit, v)) for k, v in OFFERED.items()}, F.lit(True), {k: F.array(*map(F.lit, v)) for k, v in FORMATS.items()})
    fed = decided.select("request_id", "received_at", "text", "source", "target", plan.alias("plan"))
    got = attempts.attempt(fed, "text", "source", "target", "plan", Moody, "request_id", "received_at")
    outcome = F.when(F.col("error") == "InputTooLong", "long").when(F.col("error") == "Cancelled", "cancelled").when(F.col("error").isNotNull(), "failed").when(F.col("backend") == "passthrough", "passthrough").when(F.col("fallback_used"), "fallback").otherwise("first")
    return got.select("request_id", "received_at", "backend", "device", "compute", outcome.alias("outcome"))


@query(
    f"""WITH RECURSIVE {CAPS_SQL}, asked AS (SELECT DISTINCT {CLEANED.format(c="source_language")} AS source, target_language AS target FROM requests WHERE {CLEANED.format(c="source_language")} IS NOT NULL), k AS (SELECT source, target, min(kind) AS kind FROM caps WHERE backend = 'argos' GROUP BY 1, 2)
SELECT a.source, a.target, CASE WHEN a.source = a.target THEN 'passthrough' WHEN kind IS NOT NULL THEN 'argos' END AS backend, CASE WHEN a.source = a.target THEN 'none' ELSE kind END AS kind, CASE WHEN a.source = a.target THEN 'source equals target' WHEN kind IS NOT NULL THEN 'benchmark ' || kind || ' route' END AS reason,
  '' AS fallbacks, CASE WHEN a.source <> a.target AND kind IS NULL THEN 'unsupported_language' END AS error FROM asked a LEFT JOIN k USING (source, target)"""
)
def only_backend(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "requests").select(cleaned("source_language").alias("source"), F.col("target_language").alias("target")).where("source is not null").distinct()
    return attempts.only_backend(asked, capabilities(spark), routing.PRIMARY)


@query("SELECT backend, device, round(max(duration_ms) FILTER (ok AND i = 0), 6) AS cold_ms, round(quantile_cont(duration_ms, 0.5) FILTER (ok AND i > 1), 6) AS warm_median_ms, round(quantile_disc(duration_ms, 0.95) FILTER (ok AND i > 1), 6) AS warm_p95_ms, count(*) FILTER (ok AND i > 1) AS warm, count(*) FILTER (NOT ok) AS errors, CASE WHEN bool_and(ok) THEN '' ELSE 'NoTime' END AS failures, NOT bool_and(ok) AS failed FROM (SELECT backend, device, duration_ms, coalesce(duration_ms >= 0 AND NOT isnan(duration_ms), false) AS ok, row_number() OVER (PARTITION BY backend, device, request_id ORDER BY completed_at, result_id) - 1 AS i FROM results) GROUP BY ALL".replace("i > 1", "i > 0"))
def cold_warm(spark: SparkSession, d: str) -> DataFrame:
    """The first and the later runs of the same request on the same backend and device."""
    r = read(spark, d, "results", "result_id", "request_id", "backend", "device", "duration_ms", "completed_at").withColumn("one", F.lit(1).cast("bigint"))
    ms = F.col("duration_ms")
    fine = F.coalesce((ms >= 0) & ~F.isnan(ms), F.lit(False))
    runs = ordered.running(r, ["backend", "device", "request_id"], ["completed_at", "result_id"], "one").withColumn("failure", F.when(~fine, "NoTime")).withColumn("ms", F.when(fine, ms))
    return metrics.cold_and_warm(runs, ["backend", "device"], "below", "ms", "failure", 0)


@query("SELECT c_custkey, CASE WHEN card THEN 'GPU' ELSE 'CPU' END AS device, CASE WHEN ram >= 32 AND card THEN 'Турбо' WHEN ram >= 16 THEN 'Баланс' ELSE 'Эконом' END AS mode, list_max(list_filter([2,4,6,8,12,16], lambda x: x <= least(greatest(cores // 2, 2), 16))) AS threads, CASE WHEN ram >= 32 AND card THEN '24 GB' WHEN ram >= 16 THEN '12 GB' WHEN ram >= 8 THEN '6 GB' ELSE '2 GB' END AS ram_limit, CASE WHEN vram = 0 THEN 'Автоматически' ELSE greatest(1, vram - 2) || ' GB' END AS vram_limit FROM (SELECT c_custkey, c_custkey % 64 AS ram, c_custkey % 40 AS cores, c_custkey % 7 AS vram, c_mktsegment <> 'MACHINERY' AS card FROM customer)")
def hardware_advice(spark: SparkSession, d: str) -> DataFrame:
    """What machines of different memory, cores and cards are recommended; the customers' numbers stand for machines."""
    k = F.col("c_custkey")
    m = read(spark, d, "customer", "c_custkey", "c_mktsegment").select("c_custkey", (k % 64).alias("ram_gb"), (k % 40).alias("logical_cores"), (k % 7).alias("vram_gb"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).otherwise(hardware.NO_CARD).alias("gpu"))
    return hardware.recommend(m).select("c_custkey", "device", "mode", "threads", "ram_limit", "vram_limit")


@query("SELECT job_id, CASE WHEN source = target AND source <> 'auto' THEN 'auto' ELSE target END AS kept_target, CASE profile WHEN 'Turbo' THEN 'Турбо' ELSE profile END AS mode, target AS swapped_source FROM document_configs")
def choices(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of languages kept distinct and swapped, and plain names of modes."""
    s, t = F.col("source"), F.col("target")
    return read(spark, d, "document_configs", "job_id", "source", "target", "profile").select("job_id", hardware.distinct_pair(s, t, F.lit("source"))[1].alias("kept_target"), hardware.mode_label(F.concat(F.lit("⚡  "), "profile")).alias("mode"), hardware.swapped(s, t)[0].alias("swapped_source"))


@query("SELECT job_id, i AS tick, least(100, i * 4) AS percent, least(n, round_even(n * least(100, i * 4) / 100.0, 0))::BIGINT AS processed FROM (SELECT job_id, count(*) AS n FROM documents GROUP BY 1), range(1, 26) t(i)")
def demo_progress(spark: SparkSession, d: str) -> DataFrame:
    return timers.ticks(read(spark, d, "documents", "job_id").groupBy("job_id").agg(F.count("*").alias("n")), "n").select("job_id", "tick", "percent", "processed")


@query("SELECT user_id, date_trunc('second', ts) AS tick, count(*) AS done FROM events GROUP BY 1, 2")
def progress_ticks(spark: SparkSession, d: str) -> DataFrame:
    return timers.per_tick(read(spark, d, "events", "user_id", "ts"), "user_id", "ts")


@query("SELECT result_id, concat_ws(' ', 'backend=' || backend, 'device=' || device, 'chars=' || length(translated_text), 'fallback=' || fallback_used) AS line, device FROM results")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Log lines of results, and the device that is read back from each."""
    line = files.log_line({"backend": F.col("backend"), "device": F.col("device"), "chars": F.length("translated_text"), "fallback": F.col("fallback_used")})
    r = read(spark, d, "results", "result_id", "backend", "device", "translated_text", "fallback_used").select("result_id", line.alias("line"))
    return r.select("*", files.parse_log(F.col("line"))["device"].alias("device"))


@query("SELECT job_id AS user, CASE profile WHEN 'fast' THEN 'quick' ELSE profile END AS profile, device, coalesce(CAST(threads AS VARCHAR), '4') AS threads FROM document_configs")
def settings_of_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Stored settings as keys and values, old values under new names, defaults for what is missing."""
    c = read(spark, d, "document_configs", "job_id", "profile", "device", "threads")
    stored = c.select(F.col("job_id").alias("user"), F.explode(F.create_map(F.lit("profile"), F.col("profile"), F.lit("device"), F.col("device"), F.lit("threads"), F.col("threads").cast("string"))).alias("key", "value"))
    return files.settings(stored, {"profile": "balanced", "device": "auto", "threads": "4"}, {"profile": {"fast": "quick"}})


@query("SELECT doc_id, CASE WHEN lower(file_name) LIKE '%.docx' AND NOT regexp_matches(file_name, '^(~\\$|\\.)') THEN 'file' ELSE 'skipped' END AS status, row_number() OVER (ORDER BY len(string_split(p, '/')), lower(p), doc_id) AS place FROM (SELECT doc_id, file_name, job_id || '/' || coalesce(source, 'none') || '/' || file_name AS p FROM documents)")
def scan_order(spark: SparkSession, d: str) -> DataFrame:
    """Documents' files in the order of a scan (short paths first, then by name without case), with what is passed over."""
    p = F.concat_ws("/", "job_id", F.coalesce("source", F.lit("none")), "file_name")
    rows = read(spark, d, "documents", "doc_id", "job_id", "source", "file_name").select("doc_id", "file_name", F.size(F.split(p, "/")).alias("depth"), F.lower(p).alias("low"), F.lit(1).cast("bigint").alias("one"), F.lit("").alias("all"))
    return ordered.running(rows, ["all"], ["depth", "low", "doc_id"], "one").select("doc_id", corpus.status(F.col("file_name")).alias("status"), (F.col("below") + 1).alias("place"))


@query(
    """WITH f AS (SELECT source || '-' || target AS id, entry_id, row_number() OVER (PARTITION BY source, target ORDER BY entry_id) AS o, key, CASE WHEN key IS NULL OR key <> lower(key) THEN 'MISSING' WHEN contains(key, ' ') THEN 'CORRUPTED' END AS bad FROM entries),
g AS (SELECT id, min(o) FILTER (bad IS NOT NULL) AS o, count(*) AS n FROM f GROUP BY 1), h AS (SELECT g.id, g.n, f.bad FROM g LEFT JOIN f ON f.id = g.id AND f.o = g.o)
SELECT id, CASE WHEN starts_with(id, 'de') THEN 'CORRUPTED' WHEN bad IS NOT NULL THEN bad WHEN starts_with(id, 'en') THEN 'READY' ELSE 'AVAILABLE' END AS state, CASE WHEN starts_with(id, 'de') OR bad = 'CORRUPTED' THEN 'ModelCorrupted' WHEN bad = 'MISSING' THEN 'ModelMissing' END AS error FROM h"""
)
def model_states(spark: SparkSession, d: str) -> DataFrame:
    """Models (a language pair each) whose files (an entry each) are partly missing or of another size, with states known from before."""
    e = read(spark, d, "entries", "entry_id", "source", "target", "key").withColumn("id", F.concat_ws("-", "source", "target"))
    file = F.struct(F.col("entry_id"), F.col("entry_id").cast("string").alias("path"), F.coalesce(F.length("key"), F.lit(0)).cast("bigint").alias("size"), F.lit("0" * 64).alias("sha256"))
    models = e.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(file)), lambda x: F.struct(x["path"].alias("path"), x["size"].alias("size"), x["sha256"].alias("sha256"))).alias("files"))
    there = e.where(F.col("key") == F.lower("key")).select("id", F.col("entry_id").cast("string").alias("path"), (F.length("key") + F.contains("key", F.lit(" ")).cast("int")).cast("bigint").alias("size"), F.lit(None).cast("string").alias("sha256"))
    known = models.select("id", F.when(F.startswith("id", F.lit("de")), "CORRUPTED").when(F.startswith("id", F.lit("en")), "READY").alias("state"))
    return corpus.model_states(models, there, known, full=False)


def packed(rows: DataFrame) -> DataFrame:
    """path, content: a Word package of every document's texts, a paragraph of two runs for each."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    import pyarrow as pa

    def package(texts: list[str]) -> bytes:
        run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
        body = "".join(f"<w:p>{run(t[: len(t) // 2])}{run(t[len(t) // 2 :])}</w:p>" for t in texts)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{word.NS}"><w:body>{body}<w:sectPr/></w:body></w:document>')
        return out.getvalue()

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([package(t) for t in b.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


CLEAN = "regexp_replace(text, '[\\x00-\\x1f\\x7f\\x{fffe}\\x{ffff}]', ' ', 'g')"


@query(
    f"""WITH s AS (SELECT doc_id, {CLEAN} AS t FROM segments WHERE text IS NOT NULL AND doc_id IS NOT NULL), p AS (SELECT doc_id, t, regexp_split_to_array(t, '{T.ADDRESS}') AS parts, regexp_extract_all(t, '{T.ADDRESS}') AS kept FROM s),
n AS (SELECT doc_id, t, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: replace(parts[i], 'e', '3') || coalesce(kept[i], '')), '') AS text FROM p)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM n WHERE text <> t"""
)
def docx_job(spark: SparkSession, d: str) -> DataFrame:
    """Every document's segments packed as a Word package, read, translated group by group by a double, and dealt out over the
    nodes again: the groups that changed. Addresses stay as they are."""
    t = F.regexp_replace("text", r"[\x00-\x1f\x7f\x{fffe}\x{ffff}]", " ")
    s = read(spark, d, "segments", "segment_id", "doc_id", "text").where("text is not null and doc_id is not null")
    docs = s.groupBy(F.col("doc_id").cast("string").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", t.alias("t")))), lambda x: x["t"]).alias("texts"))
    nodes = word.read_nodes(packed(docs))
    config = job.Config(source="en", target="ru")
    got = job.translate_groups(nodes, lambda texts, _: [x.replace("e", "3") for x in texts], config)
    return got.groupBy(F.col("path").alias("doc_id"), "part", "group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "text"))), lambda x: x["text"]), "").alias("text")).select("doc_id", "text")


@query(SQL["debounce"])
def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    """The streaming form of ``debounce`` over the events table, run to its end; every batch's bursts replace those before in a table
    of the shared folder, so that bursts still open are there too, and nothing goes through the driver."""
    import uuid

    folder = f"{shared_folder(spark)}/bursts-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events*.parquet")
    bursts = timers.debounce_stream(stream.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 30 * 60_000, "1 hour")
    put = lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/rows")
    bursts.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").withColumnRenamed("value", "event_id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return segment_route(spark, d)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
