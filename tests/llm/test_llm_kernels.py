"""Kernels against plain restatements, published encoders, labels and hand-made cases."""

import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.llm import bpe, langid, lookalikes, pairs, pieces, quality, sentences, truncation


# ---- sentences

CASES = [
    ["Wait ... the index of approx. 3022 entries is being built.", "It copies it."],
    ["“Where is the glossary?” asks the second user.", "“Stop!” appears in the bar."],
    ["The log ends with the words “no model found.”", "The scanner splits."],
    ["Dr. Velmar opened build 2.9.23 at 9 a.m. and saw no error.", "See sec. 69.2, fig. 34 and vol. II."],
    ["Build 4.1.27 (see No. 29) is 52.1 times faster than the U.S. build.", "It keeps links, etc.", "The rest."],
    ["Die Fassung (vgl. Nr. 4) ist 0,5-mal schneller, d. h. besser.", "Dr. Velmar kam am 3. Mai um 9 Uhr.", "Links usw.", "„Halt!“ steht da."],
    ["La versión es más rápida que la de EE. UU. y mejor.", "¿Cómo puedo ir?", "¡Abra https://docs.invalid/v1.2/a.html y pulse F5!"],
    ["Le Dr. Velmar l'a ouvert à 9 h. et n'a rien vu.", "« Où est-il ? » demande le second.", "Attendez ... l'index d'env. 42 entrées est prêt."],
    ["Д-р Вельмар открыл сборку в 9 ч. утра.", "Она быстрее, т. е. лучше.", "Рисунки и т. д.", "«Стой!» — написано там."],
    ["“STOP THE JOB NOW!” APPEARS IN THE STATUS BAR.", "THE U.S. BUILD IS OPEN.", "ALL IS WELL."],
    ["«ГДЕ ОН?» — СПРАШИВАЕТ ВТОРОЙ.", "СМ. РИС. 4 И СТР. 7."],
    ["Véase el cap. 6, la fig. 4 y la pa\u0301g. 7 del manual.", "Sеt іt tο 8 GB, е.g. fοr а.рdf."],
    ["गई है।", "डॉ. वेलमार ने खोला।"],
]


@pytest.mark.parametrize("want", CASES)
def test_sentences_with_blanks(want):
    text = " ".join(want)
    assert [text[a:b] for a, b in sentences.spans(text)] == want


@pytest.mark.parametrize("want", [["请稍候……", "请稍等……正在建立约9条的索引。", "“在哪里？”用户问道。", "最后写着：“没有。”", "昨天"], ["「止めて！」と表示されます。", "最後に「ない。」と書かれています。", "お待ちください……", "最新の版。"]])
def test_sentences_without_blanks(want):
    text = "".join(want)
    assert [text[a:b] for a, b in sentences.spans(text)] == want


@pytest.mark.parametrize("text,n", [("one.Two. three", 3), ("a first one. a second one.", 2), ("3.14", 1), ("a\nb\r\nc", 3), ("", 0), (" \n\t", 0), ("เมื่อวานเรา ไฟล์notes1.xmlเปิด", 2), ("—", 1)])
def test_sentence_counts(text, n):
    assert len(sentences.spans(text)) == n


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB.!? \n“”«»„()1。ก", max_size=80))
def test_sentences_cover_all_visible(text):
    got = sentences.spans(text)
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    left = list(text)
    for a, b in got:
        assert not text[a].isspace() and not text[b - 1].isspace()
        left[a:b] = " " * (b - a)
    assert not "".join(left).strip()


def test_very_long_line():
    text = "Dr. No said so. " * 20_000
    assert len(sentences.spans(text)) == 20_000


# ---- tokens


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary()


@pytest.fixture(scope="module")
def published():
    import base64

    import tiktoken

    with open(f"{bpe.FOLDER}/{bpe.VOCABULARY}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_published_encoder(text):
    v = bpe.vocabulary()
    import base64

    import tiktoken

    if not hasattr(test_ids_equal_the_published_encoder, "enc"):
        with open(f"{bpe.FOLDER}/{bpe.VOCABULARY}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        test_ids_equal_the_published_encoder.enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = text.encode("utf-8", "ignore").decode()
    assert v.encode([text])[0] == test_ids_equal_the_published_encoder.enc.encode_ordinary(text)


def test_verification_is_exact(vocabulary):
    """A greedy cut passes the pair checks if and only if it is the exact merging."""
    rng = random.Random(5)
    tokens = list(vocabulary.bytes.values())
    for _ in range(3000):
        b = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 4)))
        g = vocabulary.greedy(b)
        ok = bool(vocabulary.compatible(np.array(g[:-1]), np.array(g[1:])).all()) if len(g) > 1 else True
        assert ok == (g == vocabulary.merged(b))


def test_special_looking_and_long(vocabulary, published):
    for t in ("<|endoftext|>", "a" * 5000, "é" * 3000, " \n\t  x", ""):
        assert vocabulary.encode([t])[0] == published.encode_ordinary(t)


# ---- pieces


def plain_cuts(b, limit, lap):
    """Greedy cuts one after the other."""
    out, s, n = [], 0, len(b.at)
    lap = min(max(0, lap), limit - 1)
    while True:
        far = max(j for j in range(n) if b.tokens[j] <= b.tokens[s] + limit)
        far = min(max(far, s + 1), n - 1)
        end = far
        for k in (3, 2, 1):
            fits = [j for j in range(s + 1, far + 1) if b.kind[j] >= k]
            if fits and (b.tokens[fits[-1]] - b.tokens[s] > lap or fits[-1] == n - 1):
                end = fits[-1]
                break
        out.append((s, end))
        if end == n - 1:
            return out
        s = max(max(j for j in range(n) if b.tokens[j] <= b.tokens[end] - lap), s + 1)


def test_pointer_doubling_equals_plain_greedy(vocabulary):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["The cat sat.", "Кот спал,", "猫は寝た。", "x" * 40, "a-b", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    vocabulary.encode(texts)
    items = [pieces.bounds(t, vocabulary) for t in texts]
    limits, laps = [rng.choice([3, 8, 20, 64]) for _ in texts], [rng.choice([0, 2, 5]) for _ in texts]
    got = pieces.cuts(items, limits, laps)
    for t, b, limit, lap, ps in zip(texts, items, limits, laps, got):
        assert ps == plain_cuts(b, limit, lap)
        assert ps[0][0] == 0 and ps[-1][1] == len(b.at) - 1
        for s, e in ps:
            text = t[b.at[s] : b.at[e]]
            assert len(vocabulary.encode([text])[0]) == b.tokens[e] - b.tokens[s] or text[:1].isspace() or text[-1:].isspace()


# ---- look-alikes

LOOKS = [
    ("café", "café", True), ("ｈｔｍｌ", "html", True), ("page1", "page①", False), ("copy3", "copy₃", False), ("ﬁn", "fin", True), ("ё", "е", False), ("ё", "ё", True), ("ß", "ss", False),
    ("pe­re​vod", "perevod", True), ("A", "a", False), ("Ω", "Ω", True), ("К", "K", True), ("プ", "ﾌﾟ", True), ("⼀", "一", True), ("a b c", "a b c", True), ("é", "e", False), ("x²", "x2", False),
    ("ї", "ї", True), ("a‑b", "a-b", True), ("a—b", "a-b", False), ("e​́", "é", True), ("", "​", True),
]


@pytest.mark.parametrize("a,b,same", LOOKS)
def test_looks(a, b, same):
    assert (lookalikes.canonical(a) == lookalikes.canonical(b)) == same


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_canonical_is_stable(text):
    once = lookalikes.canonical(text)
    assert lookalikes.canonical(once) == once
    assert lookalikes.canonical(unicodedata.normalize("NFD", text)) == lookalikes.canonical(unicodedata.normalize("NFC", text))


# ---- languages


def test_languages_on_held_out_labels(profiles, data):
    d = data.replace("sf0.001", "sf0.01")
    docs = pd.read_parquet(f"{d}/documents.parquet")
    x = pd.read_parquet(f"{d}/doc_labels.parquet").merge(docs[["doc_id", "text"]], on="doc_id")
    x = x[x.kind != "junk"]
    got = ["mixed" if f.mixed else f.lang for f in langid.identify(list(x.text), profiles)]
    assert (np.array(got) == x.lang.to_numpy()).mean() >= 0.95


def test_odd_texts_have_defined_languages(profiles):
    got = langid.identify(["", "12345 — 3.14", "​", "x", "Пожалуйста, проверьте предел памяти ещё раз. " * 400], profiles)
    assert [f.lang for f in got][:3] == [None, None, None] and got[4].lang == "ru" and not got[4].mixed


def test_stretches(profiles):
    a, b = "The settings page protects the damaged table in reading order.", "Сканер документов сохраняет рисунки и таблицы без сети."
    f = langid.identify([f"{a} {b} {a}"], profiles)[0]
    assert f.mixed == ["en", "ru"] and [s[2] for s in f.stretches] == ["en", "ru", "en"]
    quoted = langid.identify(["Press the button “Отмена” in the window, then open the old template."], profiles)[0]
    assert quoted.lang == "en" and not quoted.mixed


# ---- quality


@pytest.mark.parametrize(
    "text,kind",
    [
        ("• one\n• two words\n• three\n• four", "list"),
        ("1. The device checks the page.\n2. The file tree splits it.\n3. It is all well.", "list"),
        ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |  |", "table"),
        ("name,size,rate\nfirst row,12,3%\nsecond row,,4%\nthird row,9,—", "table"),
        ("— Where is it?\n— I could not find it in my copy.\n— Look at the other drive, please.", "prose"),
        ("The page is long. It tells a story.\n\nThe story ends here. All is well that ends well.", "prose"),
        ("word word word word word word word word word word word word word word", "junk"),
        ("Ð\x9aÑ\x8dÑ\x88 Ñ\x81ÐµÐ³Ð¼ÐµÐ½Ñ\x82Ð¾Ð² Ð¿ÐµÑ\x80ÐµÐ·Ð°Ð³Ñ\x80Ñ\x83Ð¶Ð°ÐµÑ\x82", "junk"),
        ("4f ce 91 c6 91 89 61 a3 35 a5 e4 1a 96 02 c4 1e 07 24 70 88", "junk"),
    ],
)
def test_kinds(text, kind):
    assert (quality.doc_stats(text, quality.Vocabulary({}))[1] or ["prose"])[0] == kind


@pytest.mark.parametrize("phrase", ["The old page of the file tree never opens on my other drive. ", "请先打开设置页面再检查文件列表。", "設定ページを開いてからファイルを確認。", "กรุณาเปิดหน้าการตั้งค่าก่อน "])
def test_repetition_of_any_period(phrase):
    text = phrase * 200
    assert quality.doc_stats(text, quality.Vocabulary({}))[1] == ["junk"]
    assert quality.junk_kind(text) == "repetition"


def test_equal_places_against_brute_force():
    rng = np.random.default_rng(5)
    for n, kinds in ((12, 2), (700, 30), (2049, 3), (3000, 900), (5000, 60)):
        codes = np.minimum(rng.integers(0, kinds, n), rng.integers(0, kinds, n))
        assert quality.matches(codes).tolist() == [int((codes[k:] == codes[:-k]).sum()) for k in range(1, max(8, n // 3) + 1)]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=120))
def test_statistics_never_fail(text):
    _, _, s = quality.doc_stats(text, quality.Vocabulary({"en": frozenset({"a"})}))
    assert list(s) == list(quality.STATS) and all(np.isfinite(v) for v in s.values())
    assert (quality.junk_kind(text) is None) or len(text) >= 30


# ---- truncation

ENDINGS = [
    ("The page is open.", "done"), ("The page is op", "short"), ("One is here. The page is op", "open"), ("One is here. The page is op&am", "noise"), ("One is here. The pa�", "noise"), ("Please wait…", "done"), ("All is open. Подождите…", "done"), ("The file tree sp…", "pause"), ("The device selector", "short"),
    ("", "blank"), (None, "blank"), (" ​", "blank"), ("3.14", "wordless"), ("The log says “no model.”", "done"), ("See sec.", "open"), ("См. разд.", "open"), ("Сканер сохраняет рисунки и т. д.", "done"), ("All is well [34538956558].", "done"), ("«Остановите задание!", "open"), ("速い。とても遅", "open"),
]


@pytest.mark.parametrize("text,want", ENDINGS)
def test_endings(text, want):
    assert truncation.ending(text) == want


# ---- pairs


def test_votes_and_model(profiles):
    src = "The settings page protects the damaged table in reading order. Please check the list of pairs again."
    good = "Страница настроек защищает повреждённую таблицу в порядке чтения. Пожалуйста, проверьте список пар ещё раз."
    cases = [(good, []), (" ", ["empty"]), ("К сожалению, я не могу перевести этот текст.", ["refusal"]), (src.upper(), ["copy"]), ("Translation: " + src, ["copy"]), ("Die Einstellungsseite schützt die beschädigte Tabelle. Bitte prüfen Sie die Liste der Paare noch einmal.", ["wrong_language"]), (good[:80], ["truncated"]), (None, ["empty"])]
    keys = [pairs.pattern_of(src, c[0], "ru", profiles) for c in cases]
    model = pairs.label_model({k: 30 for k in keys} | {keys[0]: 3000})
    for k, (_, want) in zip(keys, cases):
        assert list(model.labels(k))[:1] == want[:1]


def vote(src, tgt, target, profiles):
    k = pairs.pattern_of(src, tgt, target, profiles)
    return {n: (k >> i) & 1 for i, n in enumerate(pairs.VOTES)}


def test_faithful_apology_is_no_refusal(profiles):
    k = pairs.pattern_of("Lo siento, offer360.pdf no se puede abrir.", "Sorry, offer360.pdf cannot be opened.", "en", profiles)
    assert not pairs.label_model({k: 5, 0: 2000}).labels(k)


def test_refusals_are_read_in_whole_texts(profiles):
    src = "The settings page protects the damaged table in reading order. Please check the list of pairs again. " * 4
    good = "Страница настроек защищает повреждённую таблицу в порядке чтения. Пожалуйста, проверьте список пар ещё раз. "
    late = vote(src, good * 3 + "К сожалению, я не могу перевести этот текст.", "ru", profiles)
    assert late["refusal_phrase"] and late["refusal_apology"]
    assert not vote(src + "I cannot translate this text.", "我无法翻译这段文字。", "zh", profiles)["refusal_phrase"]


def test_copies_in_other_character_forms(profiles):
    src = "The settings page protects the damaged table in reading order. Please check the list of pairs again."
    names = ["copy_equal", "copy_contains", "copy_overlap"]
    for form in (src.replace(" ", "\u2009"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in src)):
        v = vote(form, src, "ru", profiles)
        assert [v[n] for n in names] == [1, 1, 1]
    assert pairs.likeness(pairs.folded(src), pairs.folded(src.replace("damaged", "damages"))) == (False, False, True)


def test_votes_are_independent_of_each_other(profiles):
    """One defect is voted on whatever another shows: an unfinished copy is both, and an answer to a number may be empty."""
    src = "The settings page protects the damaged table. Please check the list of pairs"
    v = vote(src, src, "ru", profiles)
    assert v["copy_equal"] and v["truncated_unfinished"] and v["wrong_language_profile"]


def test_a_quoted_name_makes_no_other_language(profiles):
    v = vote("Sorry, glossary154.docx cannot be opened.", "抱歉，glossa", "zh", profiles)
    assert not v["wrong_language_profile"] and not v["wrong_language_script"]
    assert vote("The page is open.", "Страница открыта.", "zh", profiles)["wrong_language_profile"]


def test_label_model_learns_from_agreement():
    """Rates are free: a function that disagrees with the others loses its weight, whatever it starts from."""
    bit = {n: 1 << i for i, n in enumerate(pairs.VOTES)}
    a, b, c = bit["wrong_language_profile"], bit["wrong_language_script"], bit["wrong_language_of_source"]
    noisy = {0: 6000, a: 3000, a | b | c: 400, b | c: 300}
    model = pairs.label_model(noisy)
    assert "wrong_language" not in model.labels(a) and "wrong_language" in model.labels(a | b | c) and "wrong_language" in model.labels(b | c)
    assert model.false["wrong_language"][0] > 0.2
    # with starting rates alone the same vote would decide
    start = pairs.label_model({})
    assert "wrong_language" in pairs.LabelModel({d: 0.03 for d in pairs.DEFECTS}, start.hit, start.false, start.cutoff).labels(a)


def test_cutoffs_are_validated_on_held_out_pairs():
    bit = {n: 1 << i for i, n in enumerate(pairs.VOTES)}
    phrase, apology = bit["refusal_phrase"], bit["refusal_apology"]
    planted = [(phrase | apology, "refusal")] * 20 + [(apology, None)] * 20
    m = pairs.label_model({0: 5000, phrase | apology: 100, apology: 200}, planted)
    lo, hi = (float(m.posterior(np.array([k]), "refusal")[0]) for k in (apology, phrase | apology))
    assert lo < m.cutoff["refusal"] < hi and abs(m.cutoff["refusal"] - (lo + hi) / 2) < 1e-9


def test_planted_pairs(profiles):
    src, tgt = "The page is open. Please check the damaged table again.", "Страница открыта. Пожалуйста, проверьте повреждённую таблицу ещё раз."
    rows = pairs.plant([(src, tgt, "ru"), (tgt, src, "en")])
    assert {r.defect for r in rows} == {None, *pairs.DEFECTS}
    model = pairs.label_model({0: 1000}, [(int(k), r.defect) for k, r in zip(pairs.patterns_of(rows, profiles), rows)])
    assert all(0 < c < 1 for c in model.cutoff.values())


def test_label_model_of_nothing():
    assert pairs.label_model({}).labels(0) == {} and pairs.label_model({0: 1}).labels(0) == {}


SPANISH = "La página de configuración protege la tabla dañada en el orden de lectura y guarda los cambios antes de cerrar el documento"


def test_distance_of_a_repeated_text_stays(profiles):
    once = profiles.measure([SPANISH])[0]
    for k in (4, 40, 400):
        assert np.abs(profiles.measure([" ".join([SPANISH] * k)])[0] - once).max() < 0.01


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 70)), max_size=60))
def test_ranks_of_counts(rows):
    rows.sort(key=lambda x: x[0])
    owner, count = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    got = langid.ranked(owner, count, 4) if len(rows) else []
    for (o, c), g in zip(rows, got):
        own = [x for p, x in rows if p == o]
        assert g == sum(x > c for x in own) + (own.count(c) - 1) / 2


def test_language_without_a_profile(profiles):
    italian = "La pagina delle impostazioni protegge la tabella danneggiata e conserva l'ordine di lettura. Il documento viene salvato prima della chiusura. Controllare che la stampante sia collegata alla rete."
    polish = "Strona ustawień chroni uszkodzoną tabelę i zachowuje kolejność czytania. Dokument jest zapisywany przed zamknięciem. Sprawdź, czy drukarka jest podłączona do sieci."
    assert [f.lang for f in langid.identify([italian, polish, SPANISH], profiles)] == [langid.OTHER, langid.OTHER, "es"]


def best_cuts(line):
    """Brute force: the best of all subsets of the boundaries, spans scored one by one."""
    import itertools

    quotes = sentences.quotation(line)
    inner = sentences.candidates(line, quotes)
    starts = {x.begin for x in inner} | {0, len(line)}
    edge = len(line) - len(line.lstrip())

    def open_at(p):
        return any(o < p <= c for c, o in quotes.items())

    def total(cuts):
        score, begin, opens = 0.0, 0, 0.0
        for x in [*cuts, sentences.Boundary(len(line), len(line), 0.0, 0.0, False)]:
            score += opens + x.closes + sentences.length_score(max(1, x.end - begin))
            if open_at(begin) or open_at(x.begin):
                score -= sentences.UNBALANCED
            at = next((quotes[p] for p in range(x.end - 1, max(x.end - 4, -1), -1) if p in quotes), -1) if x.speaker else -1
            if at >= begin and at in starts | {edge}:
                score -= sentences.SPOKEN
            begin, opens = x.begin, x.opens
        return score

    every = [c for k in range(len(inner) + 1) for c in itertools.combinations(inner, k)]
    return max(total(c) for c in every), total, inner


LINES = [
    "One is. Two are! etc. and so on. «Stop now!» he said. Then it went.",
    "See fig. 5. «It is. It was.» Then go on, e.g. here. «Is it?» asks he.",
    "5 m. wide. No. 7 is. J. Smith etc. The end. a. b.",
    "Он сказал: «Иду. Скоро.» и ушёл. См. рис. 5. «Где?» спросил он. Да.",
]


@pytest.mark.parametrize("line", LINES)
def test_cuts_are_the_best_of_all(line):
    top, total, inner = best_cuts(line)
    got = set(sentences.boundaries(line))
    assert abs(total([x for x in inner if x.begin in got]) - top) < 1e-9


def test_whole_spans_decide(monkeypatch):
    """Cutting wherever a mark alone looks like an end gives other sentences than the scores of whole spans."""
    line = LINES[0]
    got = sentences.boundaries(line)
    alone = [x.begin for x in sentences.candidates(line, sentences.quotation(line)) if x.closes + x.opens > 0]
    assert got != alone
    monkeypatch.setattr(sentences, "UNBALANCED", 0.0)
    monkeypatch.setattr(sentences, "SPOKEN", 0.0)
    assert sentences.boundaries(line) == alone


@pytest.mark.parametrize("text", ["e.g. this etc. " * 30_000, "«" + "One is. " * 30_000 + "»", "x" * 300_000 + ". A", "5 m. a " * 20_000, "a@" * 100_000 + "."])
def test_long_lines_take_linear_time(text):
    import time

    began = time.perf_counter()
    sentences.spans(text)
    assert time.perf_counter() - began < 20


def test_common_words_decide_between_near_languages(profiles):
    titles = ["The translation engine", "El panel de progreso", "Le cache des segments"]
    assert [f.lang for f in langid.identify(titles, profiles)] == ["en", "es", "fr"]
    # a text with a clear lead keeps its nearest language whatever common words it quotes
    assert langid.identify([SPANISH + " the the the"], profiles)[0].lang == "es"
