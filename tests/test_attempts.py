"""Attempts, hops, states and reports: rules that queries on tables don't reach."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docflow.operators import attempts, corpus, hardware, inference, lexicon, metrics
from docflow.sources import files
from docflow.streaming import timers


def step(backend="a", kind="direct", device="cpu", compute="int8"):
    return {"backend": backend, "kind": kind, "device": device, "compute": compute}


class Scripted:
    """A runner that plays what is written for each attempt."""

    def __init__(self, script):
        self.script, self.seen = script, []

    def __call__(self, backend, kind, device, compute, source, target, text):
        self.seen.append((backend, device, compute))
        out = self.script[(backend, device, compute)]
        if isinstance(out, Exception):
            raise out
        return out


def run(plan, script, text="hi", source="en", target="ru", failure=None):
    runner = Scripted(script)
    return attempts.tried(text, source, target, plan, runner, failure), runner.seen


CUDA16, CUDA32, CPU8, CPU32 = step(device="cuda", compute="int8_float16"), step(device="cuda", compute="float32"), step(), step(compute="float32")


def test_next_format_only_after_a_devices_failure():
    gone = attempts.DeviceUnavailable()
    got, seen = run([CUDA16, CUDA32, CPU8], {("a", "cuda", "int8_float16"): gone, ("a", "cuda", "float32"): gone, ("a", "cpu", "int8"): "x"})
    assert got[0] == "x" and got[5:8] == (3, True, None) and len(seen) == 3
    got, seen = run([CPU8, CPU32, step("b")], {("a", "cpu", "int8"): ValueError(), ("b", "cpu", "int8"): "y"})
    assert got[:2] == ("y", "b") and seen == [("a", "cpu", "int8"), ("b", "cpu", "int8")]
    got, seen = run([CUDA16, CUDA32], {("a", "cuda", "int8_float16"): RuntimeError("user text"), ("a", "cuda", "float32"): "z"})  # on a card: the device's
    assert got[0] == "z" and "user text" not in "".join(got[8])


def test_blank_answers_cancelling_and_texts_that_arent_tried():
    got, _ = run([CPU8, step("b")], {("a", "cpu", "int8"): " ", ("b", "cpu", "int8"): "y"})
    assert got[0] == "y" and got[6] and "error=EmptyOutput" in got[8][0]
    got, seen = run([CPU8, step("b")], {("a", "cpu", "int8"): attempts.Cancelled()})
    assert got[0] is None and got[7] == "Cancelled" and len(seen) == 1
    assert run([], {}, text="x" * 50_001)[0][7] == "InputTooLong"
    assert run([], {}, text=" ")[0][:2] == (" ", "passthrough") and run([], {}, source="ru")[0][1] == "passthrough"
    assert run([], {})[0][7] == "BackendUnavailable" and run([], {}, failure="ModelCorrupted")[0][7] == "ModelCorrupted"
    got, _ = run([step(device=None, compute=None), step("b")], {("b", "cpu", "int8"): "y"})
    assert got[0] == "y" and got[6] and got[5] == 2  # a candidate without a device counts as tried


def test_plans(spark):
    df = spark.createDataFrame([("cpu",), ("gpu",), ("auto",)], "p string")
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    offered, formats = {"a": arr("cpu", "cuda"), "b": arr("cpu")}, {"cuda": arr("float32"), "cpu": arr("int8", "float32")}
    got = {r.p: [tuple(x) for x in r.plan] for r in df.withColumn("plan", attempts.planned(F.col("p"), F.lit(True), arr("a:direct", "b:pivot"), offered, F.lit(True), formats)).collect()}
    assert got["gpu"] == [("a", "direct", "cuda", "float32"), ("b", "pivot", None, None)]
    assert got["auto"][:3] == [("a", "direct", "cuda", "float32"), ("a", "direct", "cpu", "int8"), ("a", "direct", "cpu", "float32")] and len(got["auto"]) == 5
    assert len(got["cpu"]) == 4


def test_failed_probes_offer_nothing(spark):
    caps = spark.createDataFrame([("a", "en", "ru", "direct"), ("b", "en", "ru", "direct")], "backend string, source string, target string, kind string")
    backends = spark.createDataFrame([("a", None, ["cpu"]), ("b", "ModelCorrupted", ["cpu"]), ("c", None, None)], "backend string, failure string, devices array<string>")
    got = {r.backend: (len(r.pairs), r.devices, r.failure) for r in attempts.probed(caps, backends).collect()}
    assert got == {"a": (1, ["cpu"], None), "b": (0, [], "ModelCorrupted"), "c": (0, [], None)}
    asked = spark.createDataFrame([("en", "ru"), ("ru", "en"), ("en", "en")], "source string, target string")
    one = {(r.source, r.target): (r.backend, r.kind, r.error) for r in attempts.only_backend(asked, caps, "a").collect()}
    assert one == {("en", "ru"): ("a", "direct", None), ("ru", "en"): (None, None, "unsupported_language"), ("en", "en"): ("passthrough", "none", None)}
    assert {r.error for r in attempts.only_backend(asked, caps, "x").collect()} == {"model_missing", None}


def test_attempts_of_rows(spark):
    df = spark.createDataFrame([(1, None, "en", "ru", []), (2, "hi", "en", "ru", [("a", "direct", "cpu", "int8")])], "id int, t string, s string, g string, plan array<struct<backend:string,kind:string,device:string,compute:string>>")
    got = {r.id: (r.translated, r.backend) for r in attempts.attempt(df, "t", "s", "g", "plan", lambda: lambda *_: "ok", "id").collect()}
    assert got == {1: ("", "passthrough"), 2: ("ok", "a")}
    assert attempts.attempt(df.limit(0), "t", "s", "g", "plan", lambda: lambda *_: "", "id").count() == 0


def test_hops_and_prefixes(spark):
    class Marked(inference.WordDouble):
        def infer(self, chunks):
            assert all(c[0] == "__en__" for c in chunks)
            return [["__ru__", *(w.upper() for w in c[1:])] for c in chunks]

    model = inference.Prefixed(Marked(), "__en__", "__ru__")
    assert inference.translate_text(" a b\n\nc ", "ru", model, inference.Limits()) == " A B\n\nC "
    df = spark.createDataFrame([(1, "a b", ["x", "y", "z"]), (2, "1 2", ["x", "y"]), (3, "a", None), (4, None, ["x", "y"]), (5, "a", ["x"]), (6, "a", ["bad", "y"])], "id int, t string, p array<string>")

    def build(a, b, how):
        if a == "bad":
            raise OSError
        assert how.beam_size == 4

        class Hop(inference.WordDouble):
            def infer(self, chunks):
                return [[w + b for w in c] for c in chunks]

        return Hop()

    got = {r.id: (r.translated, r.hops, r.error) for r in inference.translate_along(df, "t", "p", build, inference.Limits(), inference.Decoding(), "id").collect()}
    assert got == {1: ("ayz byz", 2, None), 2: ("1 2", 0, None), 3: (None, 0, "UnsupportedLanguage"), 4: (None, 0, None), 5: ("a", 0, None), 6: (None, 1, "OSError")}


def test_model_states(spark):
    f = lambda p, n, s="00": {"path": p, "size": n, "sha256": s}
    models = spark.createDataFrame([("ok", [f("a", 1), f("b", 2)]), ("gone", [f("a", 1), f("b", 2)]), ("size", [f("a", 1), f("b", 2)]), ("hash", [f("a", 1)]), ("old", [f("a", 1)]), ("none", [])], "id string, files array<struct<path:string,size:bigint,sha256:string>>")
    there = spark.createDataFrame([("ok", "a", 1, "00"), ("ok", "b", 2, "00"), ("gone", "b", 3, None), ("size", "a", 1, "00"), ("size", "b", 9, "00"), ("hash", "a", 1, "11"), ("old", "a", 1, "00")], "id string, path string, size bigint, sha256 string")
    known = spark.createDataFrame([("old", "CORRUPTED"), ("ok", "READY")], "id string, state string")
    cheap = {r.id: r.state for r in corpus.model_states(models, there, known, False).collect()}
    full = {r.id: r.state for r in corpus.model_states(models, there, known, True).collect()}
    assert cheap == {"ok": "READY", "gone": "MISSING", "size": "CORRUPTED", "hash": "AVAILABLE", "old": "CORRUPTED", "none": "AVAILABLE"}
    assert full == cheap | {"hash": "CORRUPTED", "old": "AVAILABLE"}


def test_packages_found_and_index(spark):
    found = spark.createDataFrame([("/m/./x//en",), ("/m/y",)], "path string")
    models = spark.createDataFrame([("en", "x/en"), ("out", "../y")], "id string, path string")
    assert {r.path: r.model_id for r in corpus.discovered(found, models, "/m").collect()} == {"/m/./x//en": "en", "/m/y": None}
    index = spark.createDataFrame([("en", "1.9"), ("en", "1.10"), ("en", "2.0")], "k string, v string")
    assert corpus.newest_compatible(index, "k", "v", "1.99").first().v == "1.10"


def test_hardware(spark):
    m = spark.createDataFrame([(32, "X", 3, 8), (32, hardware.NO_CARD, 64, None), (8, None, None, 1)], "ram_gb int, gpu string, logical_cores int, vram_gb int")
    got = [(r.device, r.mode, r.threads, r.ram_limit, r.vram_limit) for r in hardware.recommend(m).collect()]
    assert got == [("GPU", "Турбо", 2, "24 GB", "6 GB"), ("CPU", "Баланс", 16, "12 GB", "Автоматически"), ("CPU", "Эконом", 2, "6 GB", "1 GB")]
    out = spark.createDataFrame([("8192\r\nN/A\n24576",), ("none",)], "o string")
    assert [r.g for r in out.select(hardware.probe_number(F.col("o")).alias("g")).collect()] == [24, None]
    assert '"vram_gb":null' in hardware.as_json(m, "ram_gb", "vram_gb").collect()[1].hardware
    labels = spark.createDataFrame([("⚡  Turbo",), ("Баланс",)], "l string").select(hardware.mode_label(F.col("l")).alias("m"))
    assert [r.m for r in labels.collect()] == ["Турбо", "Баланс"]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, "x"), (None, None, "y")], "name string, ms double, extra string")
    files.write_csv(rows.coalesce(1), str(tmp_path / "r"), ["name", "ms"])
    text = next((tmp_path / "r").glob("*.csv")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfname,ms") and b"x" not in text
    assert metrics.markdown_head({"a": False, "n": True}) == ["| a | n |", "|---|---:|"]
    r = spark.range(1).select(metrics.route_label(F.lit("argos"), F.lit("direct pivot route")).alias("a"), metrics.route_label(F.lit(None), F.lit(None)).alias("b")).first()
    assert (r.a, r.b) == ("argos pivot", "—")
    files.write_text(lexicon.attribution("A & B", "CC", "x"), str(tmp_path / "h.xml"))
    assert "A &amp; B" in (tmp_path / "h.xml").read_text() and len(list(tmp_path.iterdir())) == 2
    with pytest.raises(FileExistsError):
        files.write_text("", str(tmp_path / "h.xml"))
    at = timers.at_clock(rows.limit(1), F.lit(dt.datetime(2024, 5, 1, 12))).first().made_at
    assert at.startswith("2024-05-01T12:00:00")


def test_packed_models_and_profiles(spark, tmp_path):
    def pack(*names):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n in names:
                z.writestr(n, "{}")
        return b.getvalue()

    assert set(files.model_package(pack("m/metadata.json", "m/model.bin", "readme"))) == {"metadata.json", "model.bin"}
    for bad in (pack("../x", "metadata.json"), pack("a/metadata.json", "b/metadata.json"), pack("x"), pack("/metadata.json")):
        with pytest.raises(ValueError):
            files.model_package(bad)
    (tmp_path / "p.json").write_text('{"profiles": {"fast": {"allow_quality": true, "threads": 8}}}')
    r = files.profiles(spark, str(tmp_path / "p.json")).first()
    assert (r.profile, r.threads, r.allow_quality, r.beam_size) == ("fast", 8, True, None)


def test_pinned_and_endless_warm_periods(spark):
    rows = [(1, i, f"2024-01-01 00:{m:02d}:00", "x", i == 1) for i, m in enumerate((0, 1, 30, 59))]
    df = spark.createDataFrame(rows, "k int, i int, ts string, b string, p boolean").withColumn("ts", F.to_timestamp("ts"))
    loads = lambda idle, pin=None: timers.warm_periods(df, "k", "ts", "i", "b", idle, pin).first().loads
    assert loads(180) == 3 and loads(180, F.col("p")) == 2 and loads(0) == 1


def test_tei_entries_keep_their_attribution(spark):
    xml = "<entry xmlns='x'><form><orth>Haus</orth><orth>Häuser</orth></form><sense><cit type='trans'><quote>house</quote></cit><cit type='example'><quote>no</quote></cit></sense><sense><def>d</def></sense></entry>"
    df = spark.createDataFrame([(xml,), ("<entry><form><orth>x</orth></form></entry>",), ("<bad",), (None,)], "xml string")
    p = F.from_json("payload", lexicon.PAYLOAD)
    got = {r.key: (r.h, r.n, r.a) for r in lexicon.tei_entries(df, "xml", "de", "en", "CC").select("key", p["headword"].alias("h"), F.size(p["senses"]).alias("n"), p["attribution"].alias("a")).collect()}
    assert got == {"haus": ("Haus", 1, "CC"), "häuser": ("Haus", 1, "CC"), "x": ("x", 0, "CC")}
