"""Operators on DataFrames: nulls, empty tables, ties, repeated rows and clashing columns; results against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.llm import bpe, langid, lookalikes, mixing, pairs, pieces, quality, queries, ranks, sentences, truncation
from docflow.llm.tables import cut


def frame(spark, rows, schema):
    """A table with columns beside those that the operator reads, of names that clash with its own."""
    df = spark.createDataFrame(rows, schema)
    extra = {c: F.lit(1) for c in ("n", "h", "below", "part", "canon", "ending", "kind", "value", "total", "copies", "pattern", "o") if c not in df.columns}
    return df.withColumns(extra)


OPTIONS = "options_id int, max_input_tokens int, overlap_tokens int"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_sql(spark, data):
    from compare import connect, same

    con = connect(data)
    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name](spark, data), con, sql)


def test_sentences_of_table(spark):
    df = frame(spark, [(1, "A one. B two."), (1, "A one. B two."), (2, None), (3, ""), (None, "x")], "segment_id bigint, text string")
    got = sorted((r.rec_id or 0, r.end_pos) for r in sentences.sentences(df, "segments", "segment_id").collect())
    assert got == [(0, 1), (1, 6), (1, 6), (1, 13), (1, 13)]


def test_ids_of_table(spark):
    df = frame(spark, [(1, None), (2, ""), (3, "hi"), (3, "hi")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_documents(df).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and got[2][1]
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_pieces_of_table(spark):
    opts = spark.createDataFrame([(1, 8, 2), (2, None, 0), (None, 5, 0), (3, 0, 9)], OPTIONS)
    text = "The cat sat on the mat. " * 6
    df = frame(spark, [(1, text, 1), (2, text, 2), (3, None, 1), (4, "", 1), (5, "short", 1), (6, text, None), (7, text, 9), (8, "ab cd", 3)], "segment_id bigint, text string, options_id int")
    rows = pieces.split(df, opts).collect()
    assert {r.segment_id for r in rows} == {1, 8}
    own = sorted((r for r in rows if r.segment_id == 1), key=lambda r: r.piece_ord)
    assert all(r.n_tokens <= 8 for r in own) and own[0].start_pos == 0 and own[-1].end_pos == len(text)
    assert all(a.start_pos < b.start_pos <= a.end_pos for a, b in zip(own, own[1:]))


def test_percentiles_against_numpy(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.choice([1.0, 1.0, 5.5, rng.random() * 9])) for _ in range(900)] + [("c", "x", None), ("c", "x", float("nan")), ("a", "x", -1.0), ("a", "x", float("inf")), ("d", None, 0.0)]
    df = frame(spark, rows, "backend string, device string, duration_ms double").withColumn("completed_at", F.lit(dt.datetime(2024, 1, 1)))
    got = {(r.backend, r.device): r for r in ranks.percentiles(ranks.durations(df), ["backend", "device"], "value", "n", ranks.SHARES).collect()}
    want = {}
    for b, d, v in rows:
        if v is not None and v >= 0 and v != float("inf"):
            want.setdefault((b, d), []).append(v)
    assert set(got) == set(want)
    for k, vs in want.items():
        assert got[k].n == len(vs)
        for name, p in ranks.SHARES.items():
            assert abs(got[k][name] - np.quantile(vs, p)) < 1e-6
    assert ranks.percentiles(ranks.durations(df.limit(0)), ["backend", "device"], "value", "n", ranks.SHARES).count() == 0


def test_days_combine(spark, data):
    a = {(r.backend, r.device): r for r in queries.p6_percentiles(spark, data).collect()}
    b = {(r.backend, r.device): r for r in queries.p6_combined(spark, data).collect()}
    assert a == b


def test_weighted_ranks_one_hot_value(spark):
    df = spark.createDataFrame([("g", 1.0, 1_000_000), ("g", 2.0, 3), (None, 7.0, 2)], "k string, v double, w bigint")
    got = {(r.k, r.v): (r.below, r.total) for r in ranks.weighted_ranks(df, ["k"], "v", "w").collect()}
    assert got == {("g", 1.0): (0, 1_000_003), ("g", 2.0): (1_000_000, 1_000_003), (None, 7.0): (0, 2)}


def test_same_look_pairs_against_brute_force(spark):
    words = ["abc", "аbc", "ａbc", "abc", "ABC", "ab­c", "x y", "x y", None, ""]
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(words)) for i in range(80)]
    df = frame(spark, rows, "segment_id bigint, doc_id bigint, text string")
    got = {(r.id_a, r.id_b) for r in lookalikes.same_look(df, "segments", "segment_id", "text", ["doc_id"]).collect()}
    c = lookalikes.canonical
    want = {(a, b) for a, d, t in rows for b, e, u in rows if a < b and d is not None and d == e and t is not None and u is not None and t != u and c(t) == c(u)}
    assert got == want and want


def test_look_classes_against_brute_force(spark):
    words = ["abc", "аbc", "ａbc", "abc", "ABC", "ab­c", "x y", "x y", None, ""]
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(words)) for i in range(90)]
    df = frame(spark, rows, "segment_id bigint, doc_id bigint, text string")
    got = {r.id: (r.class_id, r.links) for r in lookalikes.look_classes(df, "segments", "segment_id", "text", ["doc_id"]).collect()}
    c = lookalikes.canonical
    want = {}
    for i, d, t in rows:
        if d is not None and t is not None:
            n = sum(e == d and u is not None and u != t and c(u) == c(t) for _, e, u in rows)
            if n:
                want[i] = (d, c(t), n)
    assert {i: v[1] for i, v in got.items()} == {i: v[2] for i, v in want.items()}
    assert len({v[0] for v in got.values()}) == len({v[:2] for v in want.values()})
    assert lookalikes.look_classes(df.limit(0), "s", "segment_id", "text", ["doc_id"]).count() == 0


def test_one_odd_form_among_many_copies(spark):
    """The work is linear: 300,000 equal rows and one other spelling give as many pairs, and as many rows of one class."""
    df = spark.range(300_000).select(F.col("id").alias("segment_id"), F.lit(1).cast("bigint").alias("doc_id"), F.when(F.col("id") == 7, "pаge").otherwise("page").alias("text"))
    assert lookalikes.same_look(df, "s", "segment_id", "text", ["doc_id"]).count() == 299_999
    got = lookalikes.look_classes(df, "s", "segment_id", "text", ["doc_id"])
    assert got.agg(F.count("*"), F.countDistinct("class_id"), F.sum("links")).first() == (300_000, 1, 599_998)


def test_truncated(spark):
    req = frame(spark, [("a", "The page is open. It is long."), ("a", "The page is open. It is long."), ("t", "The page"), ("w", "Please wait…"), (None, "x"), ("n", None)], "request_id string, text string")
    res = frame(
        spark,
        [(1, "a", "Страница открыта. Она дл", "b"), (2, "a", "Страница открыта.", "b"), (3, "t", "Страница", "b"), (4, "w", "Подождите…", None), (5, "a", "Страница отк…", None), (6, "zz", "Страница. Она", "b"), (7, "a", None, "b"), (8, "a", " ", "b"), (9, None, "Да", "b"), (10, "a", "the page is open. it is long", "b"), (11, "n", "Стра", "b")],
        "result_id bigint, request_id string, translated_text string, backend string",
    ).withColumn("options_id", F.lit(None).cast("int"))
    got = truncation.truncated(res, req, NO_OPTIONS(spark))
    assert sorted(r.result_id for r in got.where("truncated").collect()) == [1, 5, 6]
    rates = {r.backend: (r.n, r.truncated) for r in truncation.rates(got).collect()}
    assert rates == {"b": (8, 2), None: (2, 1)}
    assert truncation.truncated(res.limit(0), req.limit(0), NO_OPTIONS(spark)).count() == 0


def test_broken_off_texts_that_decline(spark):
    req = frame(spark, [("h", "The scan is old. The text cannot be processed in this form."), ("p", "The page is open. It is long.")], "request_id string, text string")
    res = frame(spark, [(1, "h", "Текст не может быть обработан в эт", "b"), (2, "p", "Я не могу перевести этот текст", "b"), (3, "p", "Извините. Я не могу перевести эт&am", "b")], "result_id bigint, request_id string, translated_text string, backend string").withColumn("options_id", F.lit(1))
    assert sorted(r.result_id for r in truncation.truncated(res, req, NO_OPTIONS(spark)).where("truncated").collect()) == [1, 3]


def NO_OPTIONS(spark):
    return spark.createDataFrame([], "options_id int, max_decoding_length int")


def test_hidden_limits_decide(spark):
    """A text without any whole sentence and without a source is a break at a hidden limit and none elsewhere; finished texts of
    a limit's length are none; a text sent often shows no limit."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("абвгде ") for _ in range(n))
    rows = [(i, "zz", word(256 if i < 40 else rng.choice([x for x in range(30, 900) if x != 256])), 1) for i in range(300)]
    rows += [(1000, "zz", word(255) + ".", 1), (1001, "zz", word(256), 2)] + [(2000 + i, "zz", "и" * 77, 1) for i in range(60)]
    # by UTF-8 bytes: 300 bytes of Cyrillic and Latin letters in different shares
    rows += [(3000 + i, "zz", "я" * (100 + i) + "z" * (300 - 2 * (100 + i)), 5) for i in range(40)]
    req = spark.createDataFrame([("a", "One. Two.")], "request_id string, text string")
    res = spark.createDataFrame(rows, "result_id bigint, request_id string, translated_text string, options_id int").withColumn("backend", F.lit("b"))
    limits = {(r.options_id, r.measure, r.length) for r in truncation.hidden_limits(truncation.measured(res, "translated_text", "options_id"), NO_OPTIONS(spark)).collect()}
    assert {(1, "chars", 256), (1, "utf16", 256), (5, "utf8", 300)} <= limits and not any(x[2] == 77 for x in limits)
    got = sorted(r.result_id for r in truncation.truncated(res, req, NO_OPTIONS(spark)).where("truncated").collect())
    assert got == [*range(40), *range(3000, 3040)]
    # fewer texts suffice at a declared length
    few = spark.createDataFrame([(i, "zz", word(192) if i < 4 else word(400 + 7 * i), 7) for i in range(20)], "result_id bigint, request_id string, translated_text string, options_id int").withColumn("backend", F.lit("b"))
    declared = spark.createDataFrame([(7, 192), (8, None), (None, 5)], "options_id int, max_decoding_length int")
    assert sorted(r.result_id for r in truncation.truncated(few, req, declared).where("truncated").collect()) == [0, 1, 2, 3]
    assert truncation.truncated(few, req, NO_OPTIONS(spark)).where("truncated").count() == 0


def test_mixture_keeps_targets(spark):
    rng = random.Random(9)
    rows = [(i, "word " * rng.randint(0, 30), "big" if i < 2000 else "small" if i < 2100 else None) for i in range(2200)] + [(9000, None, "big")]
    docs = frame(spark, rows, "doc_id bigint, text string, source string")
    targets = frame(spark, [(1, "big", 0.6, 1.0, 0.5), (1, "small", 0.3, 3.0, 0.5), (1, "gone", 0.1, None, 0.5), (2, "small", 0.5, None, 0.4), (2, "big", 0.5, 2.0, 0.4), (3, "big", 0.0, 1.0, 1.0), (3, None, 1.0, 1.0, 1.0)], "plan_id int, source string, target_share double, max_repeats double, size_ratio double")
    sizes, limits = mixing.plan(docs, targets)
    mix = mixing.mixture(sizes, limits).collect()
    total = sum(r.n_tokens for r in sizes.collect())
    for plan, source, share, most, ratio in [(1, "big", 0.6, 1, 0.5), (1, "small", 0.3, 3, 0.5), (2, "small", 0.5, 99, 0.4), (2, "big", 0.5, 2, 0.4)]:
        own = [r for r in mix if r.plan_id == plan and r.source == source]
        assert max(r.copies for r in own) <= most
        have = sum(r.n_tokens for r in sizes.collect() if r.source == source)
        want = min(share * ratio * total, most * have)
        assert want - 40 <= sum(r.n_tokens * r.copies for r in own) <= want + 1
    report = {(r.plan_id, r.source): r for r in mixing.shares(sizes, limits).collect()}
    assert report[1, "gone"].tokens == 0 and report[1, "gone"].missing_tokens > 0 and (3, "big") not in report
    # a smaller budget's documents are among those of a larger one
    a = {r.doc_id for r in mix if r.plan_id == 2 and r.source == "big"}
    b = {r.doc_id for r in mix if r.plan_id == 1 and r.source == "big"}
    assert a <= b or b <= a
    empty = mixing.plan(docs.limit(0), targets)
    assert mixing.mixture(*empty).count() == 0


def test_mixture_of_one_hot_hash_is_exact(spark):
    """Thresholds equal those of a plain sorted prefix."""
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "s") for i in range(500)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([(1, "s", 1.0, 1.0, 0.37)], "plan_id int, source string, target_share double, max_repeats double, size_ratio double")
    sizes, limits = mixing.plan(docs, targets)
    rows = sorted((r.h, r.n_tokens, r.doc_id) for r in sizes.collect())
    budget, took, want = round(0.37 * sum(r[1] for r in rows)), 0, set()
    for _, n, i in rows:
        if took + n > budget:
            break
        took += n
        want.add(i)
    assert {r.doc_id for r in mixing.mixture(sizes, limits).collect()} == want


def test_label_findings(spark, profiles, monkeypatch):
    monkeypatch.setattr(langid, "train", lambda *_: profiles)
    en, ru = "The settings page protects the damaged table in reading order.", "Сканер документов сохраняет рисунки и таблицы без сети."
    req = frame(spark, [("a", en, "ru"), ("a", en, "ru"), ("b", en, "en-US"), ("c", ru, None), ("d", f"{en} {ru}", "en"), ("e", "12345", None), ("f", None, None), ("g", ru, "Русский"), ("h", ru, "auto")], "request_id string, text string, source_language string")
    doc = frame(spark, [(1, en, "de", "j"), (2, ru, "ru", "j"), (3, "", None, None), (4, "T h e p a g e i s o p e n a n d l o n g e n o u g h", "de", "j"), (5, f"{en} {ru}", "fr", "j"), (6, en, "English", "k")], "doc_id bigint, text string, lang string, job_id string")
    cfg = frame(spark, [("j", "ru"), ("k", "auto"), (None, "de")], "job_id string, source string")
    words = spark.createDataFrame([], "lang string, word string")
    got = {tuple(r) for r in langid.label_findings(req, doc, cfg, words).collect()}
    assert got == {
        ("request", "a", "wrong", "en"), ("request", "c", "missing", "ru"), ("request", "d", "mixed", "en"), ("request", "d", "mixed", "ru"), ("request", "h", "missing", "ru"),
        ("document", "1", "wrong", "en"), ("config", "1", "wrong", "en"), ("document", "5", "mixed", "en"), ("document", "5", "mixed", "ru"),
    }


def test_training_without_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    p = langid.train(none, spark.createDataFrame([("en", "the"), ("ru", "и"), (None, "x"), ("de", None)], "lang string, word string"))
    assert set(p.langs) == {"en", "ru"}
    q = langid.train(none, spark.createDataFrame([], "lang string, word string"))
    assert q.langs == () and langid.identify(["x"], q)[0].lang is None


PAIR_ROWS = {
    "seg": "segment_id bigint, job_id string, text string, translated string", "cfg": "job_id string, target string", "req": "request_id string, text string, received_at timestamp",
    "res": "result_id bigint, request_id string, translated_text string, target_language string",
}


def pair_tables(spark, seg, cfg, req, res):
    made = [frame(spark, rows, ddl) for rows, ddl in zip((seg, cfg, req, res), PAIR_ROWS.values())]
    return made


def found_defects(spark, tables):
    seg, cfg, req, res = tables
    words = spark.createDataFrame([], "lang string, word string")
    return {tuple(r) for r in pairs.first_defect(pairs.defects(seg, cfg, req, res, seg, words)).collect()}


def test_pairs(spark, profiles, monkeypatch):
    monkeypatch.setattr(pairs, "train", lambda *_: profiles)
    en, ru = "The settings page protects the damaged table in reading order.", "Страница настроек защищает повреждённую таблицу в порядке чтения."
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    lead = "Here is the text that you have sent to us for translation some days ago: "
    seg = [(1, "j", en, ru), (2, "j", en, None), (3, "j", en, " "), (4, "j", en, en), (5, "j", None, ru), (6, "j", "123", ""), (7, None, en, ""), (4, "j", en, en), (8, "j", en, lead + en), (9, "j", en, en.replace("damaged", "damagd").replace("order", "ordr"))]
    seg += [(100 + i, "j", f"The page {i} is open. " + en, f"Страница {i} открыта. " + ru) for i in range(40)]
    cfg = [("j", "ru"), ("j", "ru"), (None, "de")]
    req = [("a", en, t0), ("a", en, t0), ("b", None, t0), ("c", "Another text was sent before. It is gone.", t0), ("c", en, t1), (None, en, t0)]
    long_refusal = "Мы получили ваш запрос и внимательно его рассмотрели. " * 6 + "К сожалению, я не могу перевести этот текст."
    res = [(1, "a", None, "ru"), (2, "a", ru[:40], "ru"), (3, "b", None, "ru"), (4, "zz", "", "ru"), (5, "a", "I'm sorry, but I can't translate this text.", None), (6, "c", en.upper(), "ru"), (7, "a", long_refusal, "ru"), (8, None, "", "ru"), (9, "c", en.replace("damaged", "damagd"), "ru"), (10, "a", en, "en")]
    got = found_defects(spark, pair_tables(spark, seg, cfg, req, res))
    assert got == {
        ("segment", 3, "empty"), ("segment", 4, "copy"), ("segment", 7, "empty"), ("segment", 8, "copy"), ("segment", 9, "copy"),
        ("result", 1, "empty"), ("result", 2, "truncated"), ("result", 5, "refusal"), ("result", 6, "copy"), ("result", 7, "refusal"), ("result", 9, "copy"),
    }
    # more texts than may be broadcast are fetched by a shuffle, with the same outcome
    monkeypatch.setattr(pairs, "FETCHED", 0)
    assert found_defects(spark, pair_tables(spark, seg, cfg, req, res)) == got
    assert found_defects(spark, pair_tables(spark, [], [], [], [])) == set()


def test_several_defects_are_kept(spark, profiles, monkeypatch):
    monkeypatch.setattr(pairs, "train", lambda *_: profiles)
    en = "The settings page protects the damaged table in reading order."
    seg, cfg, req, res = pair_tables(spark, [(1, "j", en, en)], [("j", "ru")], [], [])
    row = pairs.defects(seg, cfg, req, res, seg, spark.createDataFrame([], "lang string, word string")).first()
    assert row.defects == ["copy", "wrong_language"] and min(row.posteriors) > 0.5


LABELS = "doc_id bigint, kind string"


def test_kinds(spark):
    docs = frame(spark, [(i, f"The page {i} is long. It tells the story of a cat, and it ends well.", "en") for i in range(30)] + [(90, "• one\n• two\n• three\n• four", "en"), (91, None, "en"), (92, " \n", None), (93, "| a | b |\n| 1 | 2 |\n| 3 | 4 |", "en"), (94, "word " * 40, None), (94, "word " * 40, None)], "doc_id bigint, text string, lang string")
    words = spark.createDataFrame([("en", "the"), ("en", "is")], "lang string, word string")
    labels = frame(spark, [(90, "list"), (1, "prose"), (None, "junk"), (94, None)], LABELS)
    got = {r.doc_id: r.kind for r in quality.kinds(docs, words, labels).collect()}
    assert {k: v for k, v in got.items() if v != "prose"} == {90: "list", 93: "table", 94: "junk"} and 91 not in got and 92 not in got
    assert quality.kinds(docs.limit(0), words, labels.limit(0)).count() == 0


def test_kinds_need_outlier_scores(spark, monkeypatch):
    """Without the ranks nothing is found, and the greater score tells a table whose rows look like items from a list."""
    docs = spark.createDataFrame([(i, f"The page {i} is long. It tells the story.", "en") for i in range(20)] + [(90, "• one\n• two\n• three\n• four", "en")], "doc_id bigint, text string, lang string")
    words, labels = spark.createDataFrame([("en", "the")], "lang string, word string"), spark.createDataFrame([], LABELS)
    assert quality.kinds(docs, words, labels).where("kind <> 'prose'").count() == 1
    flat = lambda stats: stats.select("*", *[F.lit(0.0).alias(f"{k}_score") for k in quality.TAILS])
    monkeypatch.setattr(quality, "outlier_scores", flat)
    assert quality.kinds(docs, words, labels).where("kind <> 'prose'").count() == 0


def test_tails_are_exact(spark):
    stats = quality.statistics(spark.createDataFrame([(i, "word " * (i % 3 + 1) + "\n" + "a. b.\n" * (i % 4), "en" if i % 2 else None) for i in range(60)], "doc_id bigint, text string, lang string"), spark.createDataFrame([], "lang string, word string"))
    rows = stats.collect()
    got = {(r.lang, r.stat, r.step): (r.up, r.down) for r in quality.tails(stats).collect()}
    for lang in ("en", "und", quality.ALL):
        own = [r for r in rows if lang in (r.lang, quality.ALL)]
        for s in {s for t in quality.TAILS.values() for s in t}:
            for v in {round(r[s] * 1000) for r in own}:
                up, down = got[lang, s, v]
                assert abs(up - sum(round(r[s] * 1000) >= v for r in own) / len(own)) < 1e-9 and abs(down - sum(round(r[s] * 1000) <= v for r in own) / len(own)) < 1e-9


def test_kinds_of_groups_full_of_one_kind(spark):
    noise = ["<1$1{!: {}_\\}.$${|%<[|]%^=:}/ *^!&~## @#{#|#!|:<1#.<##.{!-", "^%>1{!!=|%#>0# {:[.}!}>==._-<|0}~%#|:0$&:->0*##-1 =.!% @%0$|", "<.!~@%^~_~~_@[^*/-#0._^&%]_<]00~[%=<_10@=1[^@>{}~*>[<[!0#&$1|"]
    rows = [(i, t, None) for i, t in enumerate(noise)] + [(i, "• страница\n• таблица\n• рисунок\n• список", "ru") for i in (8, 9)] + [(i, f"The page {i} is open. It is long.", "en") for i in range(20, 40)]
    words = spark.createDataFrame([("en", "the")], "lang string, word string")
    got = {r.doc_id: r.kind for r in quality.kinds(frame(spark, rows, "doc_id bigint, text string, lang string"), words, frame(spark, [], LABELS)).where("kind <> 'prose'").collect()}
    assert got == {0: "junk", 1: "junk", 2: "junk", 8: "list", 9: "list"}


def test_kinds_agree_with_labels(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{d}/doc_labels.parquet").select("doc_id", F.col("kind").alias("want"))
    j = queries.p10_stats(spark, d).join(labels, "doc_id")
    assert j.where("kind = want").count() >= 0.97 * j.count()
