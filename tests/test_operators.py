"""Operators on small fixtures: ordinary and odd input."""

import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.operators import corpus, lexicon, metrics, routing, segments
from docflow.plans import job
from docflow.sources import word
from docflow.streaming import timers


def value(spark, *cols):
    return spark.range(1).select(*cols).first()


# ---- text functions


def test_lookup_key_exact_and_folded(spark):
    df = spark.createDataFrame([("Стра\u0301ница ",), ("Straße",), ("e\u0301",), (None,)], "t string")
    got = [r.k for r in df.select(T.lookup_key(F.col("t")).alias("k")).collect()]
    assert got == ["страница", "strasse", "e", None] or got == ["страница", "strasse", "e", None]


@pytest.mark.parametrize("raw,want", [("CON", "_CON"), ("a/b:*?", "a_b___"), ("..", "_"), ("NUL.docx", "_NUL.docx"), ("x" * 200, "x" * 120), ("", "_")])
def test_safe_name(spark, raw, want):
    assert value(spark, T.safe_name(F.lit(raw)))[0] == want


@pytest.mark.parametrize("raw,fallback,want", [("CON", "a", "a"), ("  ", "LPT1", "_document"), ("name. ", "x", "name"), ("a<b", "x", "a_b")])
def test_safe_base(spark, raw, fallback, want):
    assert value(spark, T.safe_base(F.lit(raw), F.lit(fallback)))[0] == want


@pytest.mark.parametrize("raw,like,want", [("hello", "HELO", "HELLO"), ("hello", "Helo", "Hello"), ("hello", "helo", "hello")])
def test_restore_case(spark, raw, like, want):
    assert value(spark, T.restore_case(F.lit(raw), F.lit(like)))[0] == want


def test_doubles_letter(spark):
    assert list(value(spark, T.doubles_letter(F.lit("helo"), F.lit("hello")), T.doubles_letter(F.lit("helo"), F.lit("help")), T.doubles_letter(F.lit(""), F.lit("a")))) == [True, False, False]


def test_inside(spark):
    paths = [("a/b", True), ("../a", False), ("a/../../b", False), ("/a", False), ("C:\\a", False), ("a/../b", True), ("", False)]
    df = spark.createDataFrame(paths, "p string, want boolean")
    assert all(r.got == r.want for r in df.select("want", T.inside(F.col("p")).alias("got")).collect())


@pytest.mark.parametrize("raw,want", [("AMD Ryzen 7 5700X 8-Core Processor", "AMD Ryzen 7 5700X"), ("Intel(R) Core(TM) i7-8700 CPU @ 3.20GHz", "Intel Core i7-8700"), ("", "none"), (None, "none")])
def test_device_name(spark, raw, want):
    assert value(spark, T.device_name(F.lit(raw).cast("string"), F.lit("none")))[0] == want


def test_addresses_and_between(spark):
    r = value(spark, T.addresses(F.lit("see https://a.b/c and x@y.org.")), T.between_addresses(F.lit("see https://a.b/c and x@y.org.")))
    assert r[0] == ["https://a.b/c", "x@y.org"] and len(r[1]) == 3


# ---- segments


def plain_pieces(text, limit):
    """Brute force: the longest head that ends in white space or, at the limit, with a mark, and is at least half the limit."""
    out = []
    while len(text) > limit:
        ok = [p for p in range(limit // 2, limit + 1) if text[p - 1 : p].isspace() or (p == limit and text[p - 1] in ".!?。！？")]
        cut = max(ok, default=limit)
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text] if text else out


def test_bounded_equals_plain_rule(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab. \n。!é　\x1c") for _ in range(rng.randint(0, 90))) for _ in range(150)] + ["x" * 47, "", "a" * 12, "a" * 11 + " ", None, "ab " * 30_000, "a" * 70_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {}
    for r in segments.bounded(df, "text", "id", limit=12).collect():
        got.setdefault(r.id, {})[r.seg_ord] = r.seg_text
    for i, t in enumerate(texts):
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == plain_pieces(t or "", 12)


def test_pieces_dont_depend_on_a_texts_length():
    head = "a" * 700 + "\x1c" + "b" * 900
    assert segments.bounded_pieces(head, 1200)[0] == segments.bounded_pieces(head + "c" * 90_000, 1200)[0] == "a" * 700 + "\x1c"


def plain_spans(text, lengths):
    """Brute force: span by span the place that is nearest to the proportional one, the first of equally near ones."""
    places = [p for p in range(len(text) + 1) if p in (0, len(text)) or (text[p - 1].isspace() and not text[p].isspace()) or not any(map(str.isspace, text))]
    out, at = [], 0
    for k in range(len(lengths) - 1):
        want = round(len(text) * sum(lengths[: k + 1]) / max(1, sum(lengths)))
        end = min((p for p in places if p >= at), key=lambda p: abs(p - want))
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=60), st.lists(st.integers(0, 9), min_size=1, max_size=5))
def test_allocate_equals_plain_rule(text, lengths):
    assert segments.allocate(text, lengths) == plain_spans(text, lengths)


def test_lines_round_trip(spark):
    texts = ["  abc\r\n\r\njk  ", "\n", "a\rb\nc", "", None, "\u3000x\u3000"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    back = {r.id: r.text for r in segments.reassemble(segments.lines(df, "text", "id"), "id", "line_ord", F.lit("zh")).collect()}
    assert back == {i: t for i, t in enumerate(texts) if t}


def test_chunks_and_batches(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, None)], "id int, t array<string>")
    assert [(r.id, r.chunk_ord, r.tokens) for r in segments.chunks(df, "t", "id", size=2).orderBy("chunk_ord").collect()] == [(1, 0, ["a", "b"]), (1, 1, ["c"])]
    items = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (1, 3, 9), (1, 4, 1)], "o int, k int, n int")
    assert [r.batch for r in segments.batches(items, "o", "k", "n", 9).orderBy("k").collect()] == [0, 0, 1, 2]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id int, text string")
    assert segments.bounded(e, "text", "id").count() == 0
    assert segments.lines(e, "text", "id").count() == 0
    assert segments.reallocate(spark.createDataFrame([], "id int, t string, l array<int>"), "id", "t", "l").count() == 0


# ---- routing


def test_paths(spark):
    e = spark.createDataFrame([("b", "zh", "en"), ("b", "en", "ru"), ("b", "zh", "de"), ("b", "de", "ru"), ("b", "ru", "zh"), ("b", "zh", "ru"), ("b", "x", "y")], "backend string, source string, target string")
    got = {(r.source, r.target, r.kind): r.path for r in routing.paths(e).collect()}
    assert got["zh", "ru", "direct"] == ["zh", "ru"] and got["zh", "ru", "pivot"] == ["zh", "de", "ru"]
    assert ("x", "y", "pivot") not in got and ("y", "x", "pivot") not in got


def test_paths_of_any_length(spark):
    """A chain of ten languages has ways of nine hops, and a dense graph stays small."""
    chain = spark.createDataFrame([(a, b) for a, b in zip("abcdefghi", "bcdefghij")] + [(None, "a"), ("a", None), ("c", "c")], "source string, target string")
    got = {(r.source, r.target): r.path for r in routing.paths(chain).where("kind = 'pivot'").collect()}
    assert got["a", "j"] == list("abcdefghij") and len(got) == 36
    dense = spark.createDataFrame([(a, b) for a in "abcdefghijkl" for b in "abcdefghijkl" if a != b], "source string, target string")
    rows = routing.paths(dense).collect()
    assert len(rows) == 2 * 132 and all(len(r.path) == 3 for r in rows if r.kind == "pivot")
    assert routing.paths(chain.limit(0)).count() == 0


def test_decide(spark):
    caps = spark.createDataFrame([("argos", "en", "ru", "direct"), ("argos", "ru", "en", "direct"), ("argos", "zh", "ru", "pivot"), ("m2m100", "en", "ru", "direct"), ("m2m100", "zh", "ru", "direct")], "backend string, source string, target string, kind string")
    asked = spark.createDataFrame([("en", "ru", "balanced"), ("zh", "ru", "balanced"), ("zh", "ru", "fast"), ("zh", "ru", "economy"), ("en", "ru", "maximum"), ("en", "en", "fast"), ("fr", "ru", "fast"), (None, "ru", "fast")], "source string, target string, profile string")
    got = {(r.source, r.target, r.profile): (r.backend, r.kind, r.fallbacks, r.error) for r in routing.decide(asked, caps, routing.profiles(spark)).collect()}
    assert got["en", "ru", "balanced"] == ("argos", "direct", "m2m100:direct", None)
    assert got["zh", "ru", "balanced"][:2] == ("m2m100", "direct")
    assert got["zh", "ru", "economy"] == ("argos", "pivot", "", None)
    assert got["en", "en", "fast"][0] == "passthrough" and got["fr", "ru", "fast"][3] == "unsupported_language"
    none = routing.decide(asked.limit(1), caps.limit(0), routing.profiles(spark)).first()
    assert none.error == "model_missing"


def test_devices(spark):
    both = F.array(F.lit("cpu"), F.lit("cuda"))
    r = value(spark, *[routing.devices(F.lit(p), F.lit(a), both, F.lit(g)) for p, a, g in (("cpu", True, True), ("gpu", True, False), ("auto", True, True), ("auto", False, True))])
    assert list(r) == [["cpu"], [], ["cuda", "cpu"], ["cpu"]]


# ---- lexicon


def test_suggestions(spark):
    freqs = spark.createDataFrame([("en", "hello", 900), ("en", "help", 500), ("en", "receive", 300), ("en", "game", 1200), ("ru", "привет", 800)], "lang string, word string, freq bigint")
    asked = spark.createDataFrame([("en", "helo"), ("en", "recieve"), ("en", "Gam"), ("ru", "ПРЕВЕТ"), ("ru", "прив"), ("en", "hi"), ("ru", "Gam"), ("en", "a" * 33)], "lang string, typed string")
    got = {}
    for r in lexicon.suggestions(asked, freqs, known=1000).orderBy("rank").collect():
        got.setdefault(r.typed, []).append(r.word)
    assert got["helo"][0] == "hello" and got["recieve"] == ["receive"] and got["Gam"][0] == "Game" and got["ПРЕВЕТ"] == ["ПРИВЕТ"] and got["прив"] == ["привет"]
    assert not {"hi", "a" * 33} & set(got)


def test_lookup_caps_and_nulls(spark):
    e = spark.createDataFrame([(i, "en", "ru", "a", "{}") for i in range(20)] + [(99, "en", "ru", None, None)], "entry_id bigint, source string, target string, key string, payload string")
    q = spark.createDataFrame([("en", "ru", "a"), ("en", "ru", None), ("en", "ru", "x" * 200)], "source string, target string, key string")
    rows = lexicon.lookup(q, e).collect()
    assert sum(r.entry_id is not None for r in rows) == 12 and max(r.entry_id or 0 for r in rows) == 11 and len(rows) == 14


def test_tei(spark):
    xml = "<entry xmlns='http://www.tei-c.org/ns/1.0'><form><orth>Cat</orth></form><sense><cit type='trans'><quote>кот</quote><quote>кот</quote></cit></sense><sense><def>d</def></sense></entry>"
    got = lexicon.tei_entries(spark.createDataFrame([(xml,), ("<broken",), (None,), ("<entry/>",)], "x string"), "x", "en", "ru").collect()
    assert len(got) == 1 and got[0].key == "cat" and '"кот"' in got[0].payload


# ---- corpus


def test_status(spark):
    names = [("~$draft.docx", "skipped"), (".hidden.docx", "skipped"), ("valid.DOCX", "file"), ("a.txt", "skipped")]
    df = spark.createDataFrame(names, "n string, want string")
    assert all(r.want == r.got for r in df.select("want", corpus.status(F.col("n")).alias("got")).collect())


def test_numbered_passes_over_taken(spark):
    df = spark.createDataFrame([(1, "f", "a"), (2, "f", "a"), (3, "f", "a"), (4, "g", "a")], "id int, folder string, base string")
    taken = spark.createDataFrame([("f", "a.x"), ("f", "a (2).x")], "folder string, name string")
    got = {r.id: r.final_name for r in corpus.numbered(df, "folder", "base", F.lit(".x"), "id", taken).collect()}
    assert got == {1: "a (1).x", 2: "a (3).x", 3: "a (4).x", 4: "a.x"}


def test_first_of_null_key(spark):
    df = spark.createDataFrame([(3, None), (1, None), (2, "a")], "id int, k string")
    assert sorted(r.id for r in corpus.first_of(df, F.col("k"), [F.col("id")]).collect()) == [1, 2]


def test_differences(spark):
    ddl = "path string, size bigint, sha string"
    a = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], ddl)
    b = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, None), ("e", 1, "x")], ddl)
    assert {r.path: r.state for r in corpus.differences(a, b, "path").collect()} == {"a": "ok", "b": "size", "c": "hash", "d": "missing", "e": "extra"}


def test_manifest_errors(spark):
    good = ("ok", "m/a", [], [["a", "b"]], [("f", 3, "0" * 64)], 3)
    rows = [good, ("Bad Id", "../m", [], [["a"]], [("f", 3, "x"), ("f", -1, "0" * 64)], 9), (None, None, None, None, None, None)]
    got = {r.id: r.errors for r in corpus.manifest_errors(spark.createDataFrame(rows, corpus.MODEL)).collect()}
    assert got["ok"] == [] and set(got["Bad Id"]) == {"id", "sha", "file_size", "size", "duplicate_file", "pair", "path"} and "no_files" in got[None]


# ---- metrics and timers


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("a", None), ("a", float("nan"))], "b string, ms double")
    r = metrics.attempt_metrics(df, ["b"], "ms", F.lit(True)).first()
    assert (r.n, r.errors, r.median_ms, r.p95_ms, r.worst_ms) == (22, 2, 10.5, 19.0, 20.0)


def test_debounce_edges(spark):
    rows = [(1, "2024-01-01 00:00:00.000", "a"), (1, "2024-01-01 00:00:00.419", "b"), (1, "2024-01-01 00:00:00.839", "c")]
    df = spark.createDataFrame(rows, "k int, ts string, v string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.value for r in timers.debounce(df, "k", "ts", "v", 420).collect()) == ["b", "c"]


def test_warm_periods_edges(spark):
    rows = [(1, i, f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}", b) for i, (s, b) in enumerate([(0, "x"), (179, "x"), (359, "x"), (360, "y")])]
    df = spark.createDataFrame(rows, "k int, i int, ts string, b string").withColumn("ts", F.to_timestamp("ts"))
    assert timers.warm_periods(df, "k", "ts", "i", "b", 180).first().loads == 3


def test_stream_latest(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, ts int, v string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k int, ts int, v string").parquet(str(tmp_path / "in"))
    q = timers.latest_stream(s, "k", "ts", "v").writeStream.format("memory").queryName("latest_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k: r.v for r in spark.table("latest_test").collect()} == {1: "b", 2: "c"}


# ---- Word packages


def package(*paragraphs, extra=()):
    body = "".join(f"<w:p>{p}</w:p>" for p in paragraphs)
    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{word.NS}"><w:body>{body}<w:tbl/><w:sectPr/></w:body></w:document>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.comment = b"note"
        z.writestr("word/document.xml", xml)
        z.writestr("word/media/a.png", b"\x89PNG")
        for name, data in extra:
            z.writestr(name, data)
    return b.getvalue()


RUN = "<w:r><w:t>{}</w:t></w:r>".format


def test_groups_skip_protected():
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r>' + RUN("3") + '<w:r><w:fldChar w:fldCharType="end"/></w:r>'
    p = package(RUN("One ") + RUN("two"), "<w:fldSimple>" + RUN("x") + "</w:fldSimple>" + RUN("three"), field + RUN("four"), "<w:sdt>" + RUN("no") + "</w:sdt>")
    assert [t for _, _, t in word.text_groups(p)] == [["One ", "two"], ["three"], ["four"]]


def test_rewrite_keeps_other_members():
    p = package(RUN("One ") + RUN("two"))
    out = word.rewrite(p, {("word/document.xml", 0): ["Eins ", "zwei"]})
    assert [t for _, _, t in word.text_groups(out)] == [["Eins ", "zwei"]] and word.structure(out) == (1, 1, 0, 0)
    assert word.members(out)["word/media/a.png"] == b"\x89PNG" and zipfile.ZipFile(io.BytesIO(out)).comment == b"note"
    assert word.members(word.rewrite(p, {})) == word.members(p)


def test_bad_packages():
    for bad in (b"", b"PK no", package()[:-30]):
        with pytest.raises(word.BadPackage):
            word.members(bad)


def test_groups_end_at_breaks():
    p = package(RUN("First line") + "<w:r><w:br/></w:r>" + RUN("Second line") + "<w:r><w:tab/></w:r>" + RUN("Third") + RUN(" end"), "<w:r><w:t>a</w:t><w:drawing/><w:t>b</w:t></w:r>")
    assert [t for _, _, t in word.text_groups(p)] == [["First line"], ["Second line"], ["Third", " end"], ["a"], ["b"]]
    out = word.rewrite(p, {("word/document.xml", 1): ["Zweite Zeile"]})
    assert [t for _, _, t in word.text_groups(out)][:2] == [["First line"], ["Zweite Zeile"]] and b"br" in word.members(out)["word/document.xml"]


def test_protected_pieces():
    text = "  See https://a.b/c?d now, or write to x.y@z.org. " + "word " * 500 + "12 34"
    got = job.protected_pieces(text)
    assert "".join(a + b + c for a, b, c, _ in got) == text and max(len(a + b + c) for a, b, c, _ in got) <= 1200
    assert [b for _, b, _, spoken in got if not spoken] == ["https://a.b/c?d", "x.y@z.org"]
    assert not job.protected_pieces("123 4")[0][3] and job.protected_pieces("") == []


def test_job_end_to_end(spark, tmp_path):
    src, dst = tmp_path / "in", tmp_path / "out"
    (src / "sub").mkdir(parents=True)
    (src / "a.docx").write_bytes(package(RUN("Hello ") + RUN("big world"), RUN("123 4") + RUN("567") + RUN("8 9"), RUN("Go to https://a.b/c now")))
    (src / "sub" / "b.docx").write_bytes(package(RUN("Привет, мир")))
    (src / "bad.docx").write_bytes(b"no")
    (src / "~$a.docx").write_bytes(b"x")
    files = word.packages(spark, str(src))
    assert files.count() == 3 and {(r.name, r.status) for r in word.scanned(spark, str(src)).collect()} >= {("~$a.docx", "skipped"), ("a.docx", "file")}
    seen = tmp_path / "asked"
    seen.mkdir()

    def infer(texts, sources):
        import uuid

        (seen / uuid.uuid4().hex).write_text("\n".join(texts))
        return [t.upper() for t in texts]

    config = job.Config(target="ru", output=str(dst), template="{name}_{lang}", filenames=True)
    got = {r.path.rsplit("/", 1)[1]: r for r in job.run_job(files, infer, config, root=str(src)).collect()}
    assert got["a.docx"].error is None and got["bad.docx"].error and got["b.docx"].source == "ru" and got["a.docx"].segments == 3
    a = dst / "in_ru" / "A_ru.docx"
    assert got["a.docx"].output == str(a) and (dst / "in_ru" / "sub" / "b_ru.docx").exists()
    assert [t for _, _, t in word.text_groups(a.read_bytes())] == [["HELLO ", "BIG WORLD"], ["123 4", "567", "8 9"], ["GO TO https://a.b/c NOW"]]
    assert "https" not in "".join(f.read_text() for f in seen.iterdir())
    # what is in the target language stays byte for byte; a taken name gets a number
    assert word.members((dst / "in_ru" / "sub" / "b_ru.docx").read_bytes()) == word.members((src / "sub" / "b.docx").read_bytes())
    again = {r.path.rsplit("/", 1)[1]: r.output for r in job.run_job(files, infer, config, root=str(src)).collect()}
    assert again["a.docx"] == str(dst / "in_ru" / "A_ru (1).docx")
    assert not [p for p in dst.rglob("*") if p.name.startswith(".docflow")]
    plain = job.run_job(files.where("path like '%/a.docx'"), lambda ts, _: ["" for _ in ts], job.Config(output=str(dst))).first()
    assert plain.error == "EmptyOutput" and plain.output is None


def test_changed_source_isnt_published(tmp_path):
    content = package(RUN("x"))
    assert word.publish(str(tmp_path / "o.docx"), content, word.structure(content), lambda: False) == "changed" and not list(tmp_path.iterdir())
    (tmp_path / "s.docx").write_bytes(content)
    import hashlib

    sha = hashlib.sha256(content).hexdigest()
    assert job.still_there(f"file:{tmp_path}/s.docx", sha) and not job.still_there(f"{tmp_path}/s.docx", "0") and not job.still_there(f"{tmp_path}/gone.docx", sha)


def test_translated_directories(spark):
    files = spark.createDataFrame([("file:/r/Top/Docs/a.docx", b""), ("file:/r/Top/Docs/Sub/b.docx", b""), ("file:/r/Top/c.docx", b"")], "path string, content binary")
    langs = spark.createDataFrame([("file:/r/Top/Docs/a.docx", "en"), ("file:/r/Top/Docs/Sub/b.docx", "ru"), ("file:/r/Top/c.docx", "ru")], "path string, source string")
    got = {r.path[-6]: r.folder for r in job.destinations(files, langs, job.Config(target="ru", directories=True), "/r/Top", job.upper_double).collect()}
    # Docs and Sub in the language of the first package below them: Docs/Sub/b (ru) comes before Docs/a
    assert got == {"a": "/r/Top_ru/Docs", "b": "/r/Top_ru/Docs/Sub", "c": "/r/Top_ru"}


def test_paths_in_order_and_unfinished_jobs(spark, tmp_path):
    for n in ("b.docx", "A.docx"):
        (tmp_path / n).write_bytes(b"")
    (tmp_path / "z").mkdir()
    assert [p.rsplit("/", 1)[1] for p in word.asked_paths([str(tmp_path / n) for n in ("b.docx", "A.docx", "z", "b.docx")])] == ["z", "A.docx", "b.docx"]
    with pytest.raises(FileNotFoundError):
        word.asked_paths([str(tmp_path / "gone")])
    jobs = spark.createDataFrame([("x", 1), ("y", 2)], "path string, k int")
    there = spark.createDataFrame([("x",), ("x",)], "path string")
    assert [r.k for r in job.unfinished(jobs, True, there).collect()] == [1] and job.unfinished(jobs, False, there).count() == 0


def test_word_source(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package(RUN("x"), RUN("y")))
    spark.dataSource.register(word.WordSource)
    assert sorted(r.text for r in spark.read.format("word").load(str(tmp_path)).collect()) == ["x", "y"]


# ---- inference and files


def test_translate_text_keeps_layout():
    from docflow.operators import inference as inf

    class Same(inf.WordDouble):
        def encode(self, text):
            return list(text)

        def decode(self, tokens):
            return "".join(tokens)

        def infer(self, chunks):
            assert sum(map(len, chunks)) <= 6 or len(chunks) == 1
            return chunks

    text = "  abcdefghi\r\n\r\njklmn  "
    assert inf.translate_text(text, "zh", Same(), inf.Limits(3, 6, 99)) == text
    with pytest.raises(inf.OutputTooLong):
        inf.translate_text("abc", "zh", Same(), inf.Limits(3, 6, 3))


def test_translate_rows(spark):
    from docflow.operators import inference as inf

    df = spark.createDataFrame([(1, "one two", "ru"), (2, "12", "ru"), (3, None, "ru"), (4, " ", None), (1, "one two", "ru")], "id int, text string, target string")
    got = sorted(map(tuple, inf.translate(df, "text", "target", inf.WordDouble, inf.Limits(), "id").collect()))
    assert got == [(1, "ONE TWO", None), (1, "ONE TWO", None), (2, "12", None), (3, None, None), (4, " ", None)]

    def missing():
        raise FileNotFoundError("model")

    assert [r.error for r in inf.translate(df.limit(1), "text", "target", missing, inf.Limits(), "id").collect()] == ["FileNotFoundError"]


def test_demo(spark):
    from docflow.operators.inference import demo

    assert list(value(spark, demo(F.lit(" ПРИВЕТ ")), demo(F.lit("x")), demo(F.lit(" \n")))) == ["Hi", "Демонстрационный перевод: x", ""]


def test_archives_manifest_corpus_usage(spark, tmp_path):
    import hashlib
    import json
    import tarfile

    from docflow.sources import files

    a = tmp_path / "a"
    a.mkdir()
    with tarfile.open(a / "d.tar.xz", "w:xz") as t:
        i = tarfile.TarInfo("x.tei")
        i.size = 3
        t.addfile(i, io.BytesIO(b"abc"))
    (a / "d.tar.xz.sha512").write_text(hashlib.sha512((a / "d.tar.xz").read_bytes()).hexdigest() + "  d.tar.xz")
    (a / "bad.tar.xz").write_bytes(b"no")
    got = {r.name: (bytes(r.content) if r.content else None, r.sha512_ok) for r in files.archives(spark, str(a)).collect()}
    assert got == {"x.tei": (b"abc", True), None: (None, None)}
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"schema_version": 1, "models": [{"id": "a", "path": "p", "languages": [], "pairs": [["x", "y"]], "files": [{"path": "f", "sha256": "0" * 64, "size": 1}], "size": 1}]}))
    assert corpus.manifest_errors(files.manifest(spark, str(m))).first().errors == [] and files.manifest(spark, str(tmp_path / "none")).count() == 0
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"cases": [{"id": "1", "source": "en", "target": "ru", "text": "t", "concepts": [["a", "b"]]}]}))
    assert files.corpus(spark, str(c)).first().concepts == [["a", "b"]]
    u = tmp_path / "u.json"
    u.write_text(json.dumps({"entries": [{"source": "en", "target": "ru", "words": ["w"], "note": "first"}, {"source": "en", "target": "ru", "words": ["w", "v"], "note": "second"}]}))
    asked = spark.createDataFrame([("en", "ru", "w"), ("en", "ru", "z")], "source string, target string, word string")
    assert {r.word: r.note for r in files.first_usage(asked, files.usage(spark, str(u))).collect()} == {"w": "first", "z": None}
    assert value(spark, files.parse_log(F.lit("INFO backend=argos ms=12.5 ok=True")))[0] == {"backend": "argos", "ms": "12.5", "ok": "True"}


def test_write_lexicon(spark, tmp_path):
    from docflow.sources import files

    e = spark.createDataFrame([(1, "en", "ru", "a", "{}"), (2, "ru", "en", "б", "{}")], "entry_id bigint, source string, target string, key string, payload string")
    files.write_lexicon(e, str(tmp_path / "lex"))
    assert spark.read.parquet(str(tmp_path / "lex")).where("source = 'en' and target = 'ru'").count() == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_lexicon(e, str(tmp_path / "lex"))


# ---- ordered groups


def test_running_and_previous_against_plain(spark):
    from docflow.operators import ordered

    rng = random.Random(6)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 50), rng.randint(-3, 9), rng.choice(["x", "y", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, k string, o int, w bigint, v string")
    want, groups = {}, {}
    for r in sorted(rows, key=lambda r: (r[1] or "", r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    for g in groups.values():
        total, so_far, before = sum(r[3] for r in g), 0, None
        for r in g:
            want[r[0]] = (so_far, total, before)
            so_far, before = so_far + r[3], r[4]
    got = {r.id: (r.below, r.total) for r in ordered.running(df, ["k"], ["o", "id"], "w").collect()}
    assert got == {i: x[:2] for i, x in want.items()}
    prev = {r.id: r.p for r in ordered.with_previous(df, ["k"], ["o", "id"], {"v": "p"}).collect()}
    assert prev == {i: x[2] for i, x in want.items()}
    assert ordered.running(df.limit(0), ["k"], ["o"], "w").count() == 0 and ordered.with_previous(df.limit(0), ["k"], ["o"], {"v": "p"}).count() == 0


def test_small_lexicon_and_corpus_functions(spark, tmp_path):
    from docflow.sources import files

    v = spark.createDataFrame([("Straße",), ("new",), (None,)], "t string")
    assert {r.t for r in lexicon.unseen(v, spark.createDataFrame([("strasse",), (None,)], "t string"), "t").collect()} == {"new", None}
    r = value(spark, lexicon.summary(F.array(F.lit("a"), F.lit("b"), F.lit("a")), "; ", 3), lexicon.labelled(F.array(F.lit("n"), F.lit("x")), {"n": "noun"}))
    assert list(r) == ["a; ", ["noun", "x"]]
    p = spark.createDataFrame([("k", "1.9"), ("k", "1.10"), ("j", "x")], "k string, version string")
    assert {r.k: r.version for r in corpus.newest(p, "k", "version").collect()} == {"k": "1.10", "j": "x"}
    for _ in range(2):
        files.write_json(p, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 6
