"""Texts that were broken off before their last sentence was finished (problem 2).

Every text's length is taken under eight ways of counting. The texts of each setting are grouped by each of them; a length that
many more texts have than the lengths around it is a hidden limit, and the excess gives the odds that a text of that length was
cut. Then endings are inspected: how a text ends, beside how its source ends, is evidence for or against a break, and is added to
what its length says. So a doubtful ending is a break at a limit and none elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.sentences import BREAKS, CAND, closing, last_word, plain_letters, quotation
from docflow.llm.tables import cut, spread, spread_nulls

SHY = "­​‌‍⁠﻿"
# What a break in transfer or in an escaped form leaves behind. Fixed values.
NOISE = re.compile(rf"(?:�+|&(?:#?\w{{0,8}})?|\\(?:u[0-9a-fA-F]{{0,3}}|x[0-9a-fA-F]?)?|<[/\w]{{0,6}}|%[0-9A-Fa-f]?)[\s{SHY}]*$")
# Remarks that stand after a break. Fixed values.
REMARK = re.compile(r"(?i)[\s ]*[\[(<{](?:\.\.\.|…|truncated|cut|more|continued|обрезано|gekürzt|tronqué|truncado|截断|省略)[\])>}][\s ]*$")
ELLIPSIS = re.compile(r"(?:\.\.\.+|…+)$")
# Sentences that are whole with an ellipsis: requests to wait. Fixed values.
WAITS = frozenset(("please wait", "wait", "loading", "подождите", "пожалуйста, подождите", "загрузка", "bitte warten", "veuillez patienter", "patientez", "espere por favor", "espere, por favor", "por favor, espere", "aguarde", "por favor, aguarde", "зачекайте", "请稍候", "请稍等", "お待ちください", "少々お待ちください", "कृपया प्रतीक्षा करें"))
CLOSERS = "\"'”’»)]）」』】》“"
ENDS = ".!?…。！？।॥｡"
TRAIL = re.compile(rf"[\s{SHY}]+$")
NOT_LETTERS = re.compile(r"[\W_]+")
NUMBERED = re.compile(r"\s*\[\d{6,}\]\.?$")
THAI = re.compile("[฀-๿]")
LETTER = re.compile(r"[^\W\d_]")


def ending(text: str | None) -> str:
    """How a text ends: "blank", "wordless", "noise" (a break's leftovers), "pause" (with an ellipsis), "open" (inside a word or
    sentence after a whole sentence), "short" (without any whole sentence), "thai" or "done"."""
    if not text:
        return "blank"
    t = TRAIL.sub("", text)
    if not t:
        return "blank"
    if not LETTER.search(t):
        return "wordless"
    bare = NUMBERED.sub("", t)
    if bare != t and bare and ending(bare) == "done":
        return "done"
    m = NOISE.search(t)
    if m and not (m.group()[0] in "%<" and m.start() and t[m.start() - 1].isspace()) and not (m.group()[0] == "%" and t[m.start() - 1 : m.start()].isdigit()):
        return "noise"
    if REMARK.search(t):
        return "noise"
    core = t.rstrip(CLOSERS + "   ") if t[-1] in CLOSERS else t
    if not core or core[-1] not in ENDS:
        if THAI.match(t[-1]) or (core and THAI.match(core[-1])):
            return "thai"
        return "open" if any(x.group("m") and not x.group("m")[0].isspace() and x.end() < len(t) for x in CAND.finditer(t)) else "short"
    if ELLIPSIS.search(core):
        said = re.split(r"[.!?。！？…\n]", core.rstrip(".… "))[-1].strip().lower()
        return "done" if said in WAITS else "pause"
    line = t[max(t.rfind("\n"), 0) :]
    if core[-1] == ".":
        last = core[core.rfind("\n") + 1 : -1]
        word = last[max(0, last_word(last, len(last))[0] - 8) :]  # with what may stand before it, as "z." of "z. B."
        _, kind = closing(word.translate(plain_letters()[0]), len(word), ".")
        if kind in ("abbr", "letter"):
            return "open"
        if "://" in last:
            begin = max(last.rfind(c) for c in BREAKS | {" ", "\t", "\xa0"}) + 1
            token = last[begin:]
            if "://" in token and token.rstrip(".").rpartition("/")[2] in ("", token.rpartition("//")[2].rstrip(".")):
                return "open"
    # a quotation or bracket that stays open
    if sum(map(line.count, "(（")) > sum(map(line.count, ")）")) and not re.search(r"(?:^|\s)\w[)）]|[:;]-?\(", line):
        return "open"
    opened = sum(map(line.count, "«„「『"))
    if opened and opened > sum(1 for _ in quotation(line)):
        return "open"
    return "done"


def source_ending(text: str | None) -> str:
    """How a source ends, as far as its translation must: "none", "pause", "title" or "sentence"."""
    e = ending(text)
    if e in ("blank", "wordless"):
        return "none"
    if e == "pause":
        return "pause"
    if e == "thai":
        return "sentence" if len(THAI.findall(text)) >= 24 else "title"
    return "title" if e == "short" else "sentence"


def lengths(text: Column) -> dict[str, Column]:
    """A text's length under the ways in which a store may have counted it."""
    n = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c)))
    chars = F.length(text)
    units = (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7f]", ""))
    quoted = n('"') + n("\\") + n("\n") + n("\r") + n("\t")
    bare = n("\n") - F.regexp_count(text, F.lit("\r\n"))
    return {
        "chars": chars,
        "utf16": units,
        "utf8": F.octet_length(text),
        "html": chars + 4 * n("&") + 3 * n("<") + 3 * n(">") + 5 * n('"'),
        "json": chars + quoted,
        "json_ascii": ascii_ + quoted + 6 * (units - ascii_),
        "crlf": chars + bare,
        "utf8_crlf": F.octet_length(text) + bare,
    }


UNFINISHED = ("noise", "open", "pause", "short", "thai")  # endings that may be a break
# Evidence (natural logarithm of a ratio of probabilities) that a text with an ending was cut, by the ending of its source:
# "none" stands for no source. Thai marks no sentence's end, so its endings say little.
EVIDENCE = {
    "noise": {None: 9.0}, "open": {None: 7.0},
    "pause": {"sentence": 6.0, "title": 5.0, "pause": -6.0, "none": -1.0, None: 0.5},
    "short": {"sentence": 6.0, "pause": 5.0, "title": -6.0, "none": -6.0, None: 1.0},
    "thai": {"sentence": 1.0, "title": -6.0, "pause": -1.0, "none": -6.0, None: 0.5},
}
NO_LIMIT = -2.75  # odds (natural logarithm) that a text was cut where its length is no limit: about one in sixteen


def form_of(text: str) -> int:
    """64-bit hash of a text's letters and digits without case."""
    bare = NOT_LETTERS.sub("", text.lower())
    return int.from_bytes(hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def read_endings(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep`` with ending, and for unfinished texts refusal (whether it declines) and form (see ``form_of``)."""
    from docflow.llm.pairs import declines

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", ending string, refusal boolean, form bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            ends = [ending(t) for t in texts]
            open_ = [e in UNFINISHED for e in ends]
            refused = [o and declines(t.lower()) for t, o in zip(texts, open_)]
            forms = [form_of(t) if o else None for t, o in zip(texts, open_)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(ends, pa.string()), pa.array(refused, pa.bool_()), pa.array(forms, pa.int64())], names=[*keep, "ending", "refusal", "form"])

    return spread(df.select(F.col(text), *keep)).mapInArrow(run, schema)


def read_sources(requests: DataFrame) -> DataFrame:
    """request_id, source_end, asked_form, asked_refusal (whether it declines) of every request, once each: only these small values
    are shuffled, not the texts."""
    from docflow.llm.pairs import declines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([source_ending(t) for t in texts], pa.string()), pa.array([form_of(t) for t in texts], pa.int64()), pa.array([declines(t.lower()) for t in texts], pa.bool_())], names=["request_id", "source_end", "asked_form", "asked_refusal"])

    rows = requests.where("request_id is not null and text is not null").select("text", F.col("request_id").cast("string"))
    got = spread(rows).mapInArrow(run, "request_id string, source_end string, asked_form bigint, asked_refusal boolean")
    return got.groupBy("request_id").agg(F.max("source_end").alias("source_end"), F.max("asked_form").alias("asked_form"), F.max("asked_refusal").alias("asked_refusal"))


MEASURES = ("chars", "utf16", "utf8", "html", "json", "json_ascii", "crlf", "utf8_crlf")
NEAR = 8  # lengths on either side that a limit's length is compared with
LEAST, DEVIATIONS = 8, 7.0  # texts of one length that may show a limit, and by how many deviations they must exceed those around
DECLARED_LEAST, DECLARED_DEVIATIONS = 3, 3.0  # as much suffices at the length that the settings declare


def measured(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep``, the MEASURES and text_hash of every row of ``df``, of whose columns no other is read."""
    cols = lengths(F.col(text))
    return df.select(*keep, *[cols[m].alias(m) for m in MEASURES], F.xxhash64(text).alias("text_hash"))


def hidden_limits(seen: DataFrame, options: DataFrame) -> DataFrame:
    """options_id, measure, length, n, around, odds: lengths at which the texts of a setting pile up, by each way of counting.

    ``seen``: options_id (null: a setting of its own), the MEASURES and text_hash of all texts, finished or not. ``options``:
    options_id, max_decoding_length; at the declared length fewer texts show a limit. Of the lengths that many rows have, only those
    stay that many different texts have (n), so a text sent often shows none. ``odds``: logarithm of the excess over what lies around.
    """
    long = seen.select("options_id", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in MEASURES])).alias("x")).select("options_id", "x.*")
    counts = long.groupBy("options_id", "measure", "length").agg(F.count("*").alias("n"))
    w = Window.partitionBy("options_id", "measure").orderBy("length").rangeBetween(-NEAR, NEAR)  # one row per length
    around = (F.sum("n").over(w) - F.col("n")) / (2 * NEAR)
    declared = options.where("options_id is not null and max_decoding_length > 0").groupBy("options_id").agg(F.max("max_decoding_length").alias("__declared"))
    got = counts.withColumn("around", around).join(declared, "options_id", "left")
    rare = F.greatest("around", F.lit(0.5))
    own = F.coalesce(F.col("length") == F.col("__declared"), F.lit(False))
    beyond = (F.col("n") - F.col("around")) / F.sqrt(rare)
    high = (F.col("n") >= F.when(own, DECLARED_LEAST).otherwise(LEAST)) & (beyond >= F.when(own, DECLARED_DEVIATIONS).otherwise(DEVIATIONS))
    odds = F.round(F.log((F.col("n") - F.col("around")) / rare), 6)
    piles = cut(got.where(high).withColumn("odds", odds))
    marks, _ = at_limits(limit_maps(piles))
    texts = seen.select("options_id", "text_hash", *MEASURES, F.explode(marks).alias("measure"))
    of = F.coalesce(*[F.when(F.col("measure") == m, F.col(m)) for m in MEASURES])
    texts = texts.select("options_id", "measure", of.alias("length"), "text_hash").distinct().groupBy("options_id", "measure", "length").agg(F.count("*").alias("__n"))
    same = F.col("a.options_id").eqNullSafe(F.col("b.options_id")) & (F.col("a.measure") == F.col("b.measure")) & (F.col("a.length") == F.col("b.length"))
    both = piles.alias("a").join(texts.alias("b"), same).select("a.options_id", "a.measure", "a.length", F.col("b.__n").alias("n"), "a.around", "a.__declared")
    return both.where(high).select("options_id", "measure", "length", "n", "around", odds.alias("odds"))


def limit_maps(limits: DataFrame) -> dict[str, Column]:
    """For each measure a map from "options_id:length" to the odds of the limit there.

    A limit stands out among 2 * NEAR lengths and has LEAST texts at least, so the limits of a setting are few whatever the number of texts.
    """
    of: dict[str, list[Column]] = {}
    for r in limits.select("options_id", "measure", "length", "odds").collect():
        of.setdefault(r.measure, []).extend((F.lit(f"{'' if r.options_id is None else r.options_id}:{r.length}"), F.lit(float(r.odds))))
    return {m: F.create_map(*xs) for m, xs in of.items()}


def at_limits(maps: dict[str, Column]) -> tuple[Column, Column]:
    """(ways of counting by which a row's text has just a limit's length, the greatest odds of them) by options_id and MEASURES."""
    key = lambda m: F.concat_ws(":", F.coalesce(F.col("options_id").cast("string"), F.lit("")), F.col(m).cast("string"))
    if not maps:
        return F.array().cast("array<string>"), F.lit(None).cast("double")
    odds = {m: x[key(m)] for m, x in maps.items()}
    return F.array_compact(F.array(*[F.when(o.isNotNull(), F.lit(m)) for m, o in odds.items()])), F.greatest(*odds.values(), F.lit(None).cast("double"))


def examined(results: DataFrame, requests: DataFrame) -> DataFrame:
    """result_id, backend, options_id, ending, source_end, refusal, copied and the MEASURES of every result with a text."""
    wide = measured(results.where("translated_text is not null"), "translated_text", "translated_text", "result_id", "request_id", "backend", "options_id")
    got = read_endings(wide, "translated_text", "result_id", "request_id", "backend", "options_id", *MEASURES, "text_hash")
    both = got.withColumn("request_id", spread_nulls("request_id", "result_id")).join(read_sources(requests), "request_id", "left")
    # a text that declines as its source does is a translation; one with a break's leftovers, or open after a whole sentence, was broken off
    both = both.withColumn("refusal", F.col("refusal") & ~F.coalesce("asked_refusal", F.lit(False)) & ~F.col("ending").isin("noise", "open")).drop("asked_refusal")
    # a source handed back without its last mark or in other letter case is a copy, not a broken-off text
    return both.withColumn("copied", F.coalesce(F.col("form") == F.col("asked_form"), F.lit(False))).drop("form", "asked_form")


def evidence() -> Column:
    """EVIDENCE of a row's ending and source_end; null for endings that are no break."""
    e, s = F.col("ending"), F.col("source_end")
    out = F.lit(None).cast("double")
    for ending_, by in EVIDENCE.items():
        value = F.lit(by[None])
        for source, x in by.items():
            if source is not None:
                value = F.when(s == source, x).otherwise(value)
        out = F.when(e == ending_, value).otherwise(out)
    return out


def truncated(results: DataFrame, requests: DataFrame, options: DataFrame) -> DataFrame:
    """result_id, backend, ending, truncated, limits (ways of counting by which the text has just a hidden limit's length), odds.

    Null texts give no row, blank and wordless ones are not truncated. Repeated rows stay and count in the limits.
    """
    seen = cut(examined(results, requests))
    marks, odds = at_limits(limit_maps(hidden_limits(seen, options)))
    got = seen.withColumn("limits", marks).withColumn("odds", F.coalesce(odds, F.lit(NO_LIMIT)) + evidence())
    off = (F.col("odds") > 0) & ~F.col("refusal") & ~F.col("copied")
    return got.select("result_id", "backend", "ending", F.coalesce(off, F.lit(False)).alias("truncated"), "limits", "odds")


def rates(found: DataFrame) -> DataFrame:
    """backend, n, truncated, rate, at_limit of the texts of every backend (null: a group of its own)."""
    t = F.col("truncated").cast("int")
    return found.groupBy("backend").agg(F.count("*").alias("n"), F.sum(t).alias("truncated"), F.round(F.avg(t), 6).alias("rate"), F.sum((F.col("truncated") & (F.size("limits") > 0)).cast("int")).alias("at_limit"))
