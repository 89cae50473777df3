"""Defective pairs of a text and its translation (problem 4).

Each side of a pair is read where it is stored and reduced to a few numbers: how it ends, whether it declines, its language, its
length. Only these are brought together; both texts are fetched only of the pairs whose translation isn't wholly in the wanted
language, for an unchanged text that already is in it makes no copy.

Labelling functions then vote on every pair, several for each defect, each blind to the others' votes. An expectation-maximization
label model learns each function's hit and false-alarm rate from how the votes of all pairs agree, over the counts of vote
patterns; planted defects, whose labels are known, take part with their labels. The half of them that it has not seen gives the
cutoff of each defect. A pair keeps all defects above the cutoffs; p4_found names the first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import add

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.langid import HAS_OTHER, LEAST_EVIDENCE, NOT_WORDS, SCRIPT_TABLE, Profiles, pieces, train
from docflow.llm.langs import LANGS, label_code
from docflow.llm.tables import cut, small, spread
from docflow.llm.truncation import LETTER, SHY, ending, source_ending

DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")  # in the order in which one is named

# Phrases that decline a task, by language. Fixed values.
REFUSALS = (
    r"(?:can(?:no|')?t|can ?not|could(?: not|n't)|won't|will not|unable to|not able to|not allowed to|must decline|have to decline|decline to)\b.{0,24}\b(?:assist|help|translate|comply|process|fulfil|fulfill|answer|do (?:that|this)|provide|complete|continue|support)",
    r"(?:content|request|text|input|message)\b.{0,16}\b(?:cannot|can't|can not|could not|may not) be (?:processed|translated|handled|completed|fulfilled|answered)",
    r"\bas an? (?:ai\b|(?:large )?language model|assistant)", r"\bi (?:refuse|decline)\b", r"against (?:my|our) (?:policy|policies|guidelines)",
    r"не (?:могу|можем|смогу|вправе|в состоянии)(?: \S+){0,4} (?:помочь|перевести|выполнить|обработать|ответить|продолжить|сделать|предоставить)", r"(?:помочь|перевести|выполнить|обработать)(?: \S+){0,3} не (?:могу|можем|смогу|получится)", r"как (?:языковая модель|ии\b|искусственный интеллект)", r"отказываюсь", r"(?:запрос|содержание|текст|содержимое) не может быть (?:обработан|переведен|переведён|выполнен)",
    r"не (?:можу|зможу|маю змоги)(?: \S+){0,4} (?:допомогти|перекласти|виконати|обробити|відповісти)", r"як мовна модель",
    r"kann (?:ich )?(?:\S+ ){0,5}nicht (?:helfen|übersetzen|bearbeiten|beantworten|ausführen|erfüllen|weiterhelfen|verarbeiten)", r"(?:kann|darf) nicht (?:bearbeitet|übersetzt|verarbeitet) werden", r"als (?:ki|sprachmodell|künstliche)\b",
    r"no (?:puedo|podemos|podré|me es posible)(?: \S+){0,3} ?\b(?:traducir|ayudar\w*|procesar|atender|responder|cumplir|completar|realizar)", r"como (?:modelo de lenguaje|ia\b|una ia)", r"no (?:se puede|puede ser) (?:procesar|procesado|traducir|traducido) (?:este|esta|el contenido)",
    r"ne (?:peux|pouvons|pourrai|suis) (?:pas|malheureusement pas)(?: \S+){0,4} ?\b(?:traduire|aider|traiter|répondre|satisfaire|donner suite|en mesure)", r"en tant que (?:modèle|ia\b|qu'ia)", r"ne peut (?:pas )?être (?:traité|traduit)e?",
    r"não (?:posso|podemos|consigo|poderei)(?: \S+){0,3} ?\b(?:traduzir|ajudar\w*|processar|atender|responder|cumprir)", r"como (?:um )?modelo de linguagem",
    r"(?:无法|不能|不可以|没办法|難以|无法为您|不便)(?:为您|帮您|帮助|協助|协助|提供|翻译|翻譯|处理|處理|完成|回答|满足|执行)", r"作为(?:一个)?(?:人工智能|语言模型|ai)", r"(?:内容|请求|文本)(?:无法|不能)(?:被)?(?:处理|翻译)",
    r"(?:翻訳|お手伝い|お答え|お応え|対応|処理|お受け|回答|ご依頼\S{0,6})(?:は|が|を|に|する(?:こと)?(?:は|が)?)?(?:でき|出来|いたしかね|しかね)(?:ません|ない|ます|かねます)?", r"言語モデルとして", r"できかねます", r"(?:aiとして|人工知能として)",
    r"मदद नहीं कर", r"अनुवाद नहीं कर", r"सहायता नहीं कर", r"ไม่สามารถ(?:ช่วย|แปล|ดำเนินการ|ตอบ)", r"ขออภัย.{0,20}ไม่สามารถ",
)
# For each group of the phrases above, parts of which each of its phrases holds one: texts without them needn't be matched. Fixed values.
PARTS = (
    (0, 5, "cannot|can't|cant|can not|could not|couldn't|won't|will not|unable to|not able to|not allowed to|decline|refuse|may not|as a|against my|against our"),
    (5, 10, "не могу|не можем|не смогу|не вправе|не в состоянии|не получится|языковая модель|как ии|искусственный интеллект|отказываюсь|не может быть"),
    (10, 12, "не можу|не зможу|не маю змоги|мовна модель"),
    (12, 15, "kann |darf nicht|als ki|als sprachmodell|als künstliche"),
    (15, 18, "no puedo|no podemos|no podré|no me es posible|como modelo|como ia|como una ia|no se puede|no puede ser"),
    (18, 21, "ne peux|ne pouvons|ne pourrai|ne suis|en tant que|ne peut"),
    (21, 23, "não posso|não podemos|não consigo|não poderei|modelo de linguagem"),
    (23, 26, "无法|不能|不可以|没办法|難以|不便|作为"),
    (26, 30, "でき|出来|かね|言語モデル|aiとして|人工知能"),
    (30, 35, "मदद नहीं|अनुवाद नहीं|सहायता नहीं|ไม่สามารถ"),
)
GROUPS = [re.compile("(?:" + "|".join(REFUSALS[a:b]) + ")") for a, b, _ in PARTS]
# Words of apology, a weaker sign. Fixed values.
APOLOGY = re.compile(r"(?i)\b(?:sorry|apologi[sz]e|unfortunately|regret)\b|извин|к сожалению|прошу прощения|на жаль|вибач|leider|tut mir leid|bedaure|lo siento|lamento|lamentablemente|désolé|malheureusement|regrette|desculp|infelizmente|抱歉|对不起|很遗憾|申し訳|すみません|क्षमा|माफ़|ขออภัย|เสียใจ|this (?:content|request)|language model|этот запрос|diese anfrage|この(?:文章|ご依頼)|这个请求|这段文字")
NOT_ALNUM = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """Letters and digits only, without case, width and composition."""
    return NOT_ALNUM.sub("", unicodedata.normalize("NFKC", text).casefold())


# Labelling functions of each defect: (name, hit rate, false-alarm rate) that expectation-maximization starts from.
FUNCTIONS = {
    "empty": (("invisible", 0.99, 0.0001), ("wordless", 0.99, 0.01), ("tiny", 0.95, 0.02)),
    "refusal": (("phrase", 0.95, 0.0005), ("apology", 0.7, 0.03), ("own_length", 0.6, 0.2)),
    "copy": (("equal", 0.6, 0.0002), ("contains", 0.85, 0.0005), ("overlap", 0.97, 0.0005)),
    "wrong_language": (("profile", 0.95, 0.0005), ("script", 0.6, 0.002), ("of_source", 0.5, 0.01)),
    "truncated": (("unfinished", 0.97, 0.001), ("unclosed", 0.98, 0.15), ("leftover", 0.2, 0.0005), ("shorter", 0.4, 0.02)),
}
VOTES = [f"{d}_{f[0]}" for d, fs in FUNCTIONS.items() for f in fs]
CHARS_PER = {"zh": 0.35, "ja": 0.5, "th": 0.9}  # characters of a language for one of an alphabet. Fixed values.
BIGRAM_MIN = 0.85


def bigrams(t: str) -> set[str]:
    return set(map(add, t, t[1:]))


# Parts of which every apology has one. Fixed values.
SORRY = "sorry apolog unfortun regret извин сожал прош жаль вибач leider leid bedau siento lament désol malheur desculp infeliz 抱歉 对不起 遗憾 申し訳 すみません क्षमा माफ़ ขออภัย เสียใจ this model этот diese この 这个 这段".split()


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """Finds all parts of refusals (with the number of their group) and of apologies (with -1) in one pass over a text."""
    out = ahocorasick.Automaton()
    for k, (_, _, parts) in enumerate(PARTS):
        for x in parts.split("|"):
            out.add_word(x, k)
    for x in SORRY:
        if x not in out:
            out.add_word(x, -1)
    out.make_automaton()
    return out


def manners(low: str) -> tuple[bool, bool]:
    """Whether a text in small letters declines the task, and whether it apologizes, anywhere."""
    hints = {k for _, k in automaton().iter(low)}
    if not hints:
        return False, False
    return any(k >= 0 and GROUPS[k].search(low) for k in hints), -1 in hints and bool(APOLOGY.search(low))


def declines(low: str) -> bool:
    return manners(low)[0]


def languages_of(texts: list[str], profiles: Profiles) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Main language's number (-1: none) of each text; distances to all languages, letters and text of each sentence."""
    cuts = [pieces(t) if t else [] for t in texts]
    flat = [t[a:b] for t, p in zip(texts, cuts) for a, b in p]
    n, k = len(texts), len(profiles.langs)
    if not flat or not k:
        return [-1] * n, np.zeros((0, max(k, 1))), np.zeros(0), np.zeros(0, np.int64)
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    far, letters = profiles.measure([NOT_WORDS.sub(" ", x) if HAS_OTHER.search(x) else x for x in distinct])
    far, letters = far[codes], letters[codes]
    owner = np.repeat(np.arange(n), [len(p) for p in cuts])
    total = np.stack([np.bincount(owner, weights=far[:, j] * letters, minlength=n) for j in range(k)], axis=1)
    weight = np.bincount(owner, weights=letters, minlength=n)
    return np.where(weight > 0, np.argmin(total, axis=1), -1).tolist(), far, letters, owner


def likeness(fs: str, ft: str) -> tuple[bool, bool, bool]:
    """How a folded text repeats its folded source: equal, contains (one the other), overlap (nearly the same bigrams). Exact.

    A source counts as contained whatever stands around it, a very short one only if it is a fair part of the text.
    """
    if not fs:
        return False, False, False
    equal = fs == ft
    holds = equal or (fs in ft and (len(fs) >= 12 or len(ft) <= len(fs) + 60 and len(fs) >= 4)) or (ft in fs and len(ft) >= 0.75 * len(fs))
    if holds or len(ft) < 8:
        return equal, holds, holds
    # more bigrams of the text's beginning are missing in the source than may be missing of the whole text
    if sum(x not in fs for x in bigrams(ft[: len(ft) // 3 + 2])) > (1 - BIGRAM_MIN) / BIGRAM_MIN * (len(ft) - 1):
        return equal, holds, False
    a, b = bigrams(ft), bigrams(fs)
    return equal, holds, min(len(a), len(b)) >= BIGRAM_MIN * max(len(a), len(b)) and len(a & b) >= BIGRAM_MIN * len(a | b)


# ---- what one side of a pair shows, as whole numbers

ENDINGS = ("blank", "wordless", "noise", "pause", "open", "short", "thai", "done")
SOURCE_ENDINGS = ("none", "pause", "title", "sentence")
NO_LANG = 15  # stands for no language among the numbers of LANGS
LANG_BITS = len(LANGS)
OWN_SCRIPT = np.array([{"th": 4, "hi": 3, "ru": 1, "uk": 1, "zh": 2, "ja": 2}.get(x, 0) for x in LANGS])

SIGNS = np.array([1, 1, 3, 1, 1])  # letters of an alphabet that a letter of each script stands for


def bare(text: str) -> str:
    return NOT_WORDS.sub(" ", text) if HAS_OTHER.search(text) else text


def scripts_of(texts: list[str]) -> np.ndarray:
    """Letters of each text by script: Latin, Cyrillic, Chinese and Japanese, Devanagari, Thai."""
    n = len(texts)
    cp = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.cumsum(cp == 0) - (cp == 0)
    counts = np.bincount(owner * 8 + SCRIPT_TABLE[cp], minlength=(int(owner[-1]) + 1) * 8).reshape(-1, 8)[:, 1:7]
    if len(counts) != n:  # a text holds the separator
        return np.concatenate([scripts_of([t.replace("\0", " ")]) for t in texts])
    return np.stack([counts[:, 0], counts[:, 1], counts[:, 2] + counts[:, 3], counts[:, 4], counts[:, 5]], axis=1)


def sources_seen(texts: list[str]) -> list[tuple[int, int]]:
    """(signature, length) of each source; the signature is 0 for a text without words.

    Bits: words, declines, apologizes, mostly of Chinese and Japanese signs; ending (2).
    """
    out, plain = [], [bare(t) for t in texts]
    dense = scripts_of(plain) if texts else np.zeros((0, 5))
    for t, p, by in zip(texts, plain, dense):
        if not LETTER.search(p):
            out.append((0, len(t)))
            continue
        no, sorry = manners(t.lower())
        out.append((1 | no << 1 | sorry << 2 | int(2 * by[2] > by.sum()) << 3 | SOURCE_ENDINGS.index(source_ending(t)) << 4, len(t)))
    return out


def answers_seen(texts: list[str | None], profiles: Profiles) -> list[tuple[int, int]]:
    """(signature, length) of each translation.

    Bits: visible, words, declines, apologizes; ending (3); language (4); whether no sentence shows another language; then for each
    language whether it isn't the text's, and whether few of the letters are of its script.
    """
    clean = [t or "" for t in texts]
    index = {x: j for j, x in enumerate(profiles.langs)}
    main, far, letters, owner = languages_of(clean, profiles)
    whole = wholly(main, far, letters, owner)
    n, k = len(clean), max(1, far.shape[1])
    total = np.stack([np.bincount(owner, weights=far[:, j] * letters, minlength=n) for j in range(k)], axis=1) if len(owner) else np.zeros((n, k))
    weight = np.bincount(owner, weights=letters, minlength=n) if len(owner) else np.zeros(n)
    own = np.array(main, dtype=np.int64)
    lead = total - total[np.arange(n), np.maximum(own, 0)][:, None]
    off = np.zeros((n, LANG_BITS), bool)
    for b, x in enumerate(LANGS):
        if x in index:
            off[:, b] = (own >= 0) & (own != index[x]) & (weight >= 6) & (lead[:, index[x]] >= LEAST_EVIDENCE)
    by = scripts_of([bare(t) for t in clean]) * SIGNS if clean else np.zeros((0, 5))
    all_ = by.sum(axis=1)
    strange = (all_ >= 4)[:, None] & (by[:, OWN_SCRIPT] < 0.3 * all_[:, None])
    # a text that has a fair part of the language's own script isn't in another one of another script, as where a long name is quoted
    alike = OWN_SCRIPT[np.array([LANGS.index(x) for x in profiles.langs], np.int64)][np.maximum(own, 0)][:, None] == OWN_SCRIPT if k and profiles.langs else np.ones_like(strange)
    off &= strange | alike
    powers = 1 << np.arange(LANG_BITS)
    masks = ((off * powers).sum(axis=1) << 12) | ((strange * powers).sum(axis=1) << (12 + LANG_BITS))
    number = [LANGS.index(x) for x in profiles.langs]
    out = []
    for i, t in enumerate(clean):
        words = bool(LETTER.search(t))
        visible = words or any(not c.isspace() and c not in SHY for c in t)
        no, sorry = manners(t.lower())
        lang = number[main[i]] if main[i] >= 0 else NO_LANG
        sig = visible | words << 1 | no << 2 | sorry << 3 | ENDINGS.index(ending(t)) << 4 | lang << 7 | int(whole[i]) << 11
        out.append((int(sig) | int(masks[i]) if words else int(sig), len(t)))
    return out


def wholly(main: list[int], far: np.ndarray, letters: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether none of a text's sentences shows another language than its main one."""
    own = np.array(main, dtype=np.int64)
    if not len(owner) or not len(own):
        return np.ones(len(own), bool)
    foreign = (far[np.arange(len(far)), np.maximum(own[owner], 0)] - far.min(axis=1)) * letters >= LEAST_EVIDENCE
    return np.bincount(owner, weights=foreign, minlength=len(own)) == 0


def compared(sources: list[str], texts: list[str], profiles: Profiles) -> list[int]:
    """What only both texts together show: bits equal, contains, overlap of folded letters; whether the source is wholly in its
    language (1); the source's language (4)."""
    main, far, letters, owner = languages_of(sources, profiles)
    whole = wholly(main, far, letters, owner)
    out = []
    for s, t, m, w in zip(sources, texts, main, whole):
        equal, holds, lapped = likeness(folded(s), folded(t))
        lang = LANGS.index(profiles.langs[m]) if m >= 0 else NO_LANG
        out.append(equal | holds << 1 | lapped << 2 | int(w) << 3 | lang << 4)
    return out


APART = NO_LANG << 4  # for pairs whose texts needn't be compared


# ---- votes


def votes(s_sig, s_len, t_sig, t_len, like, target) -> np.ndarray:  # noqa: ANN001 - arrays of whole numbers
    """The labelling functions' votes on each pair as bits, in the order of VOTES.

    ``like``: as of ``compared``, APART if a pair wasn't; ``target``: the number of the wanted language, NO_LANG for another one, -1 for none.
    """
    bit = lambda x, k: (x >> k) & 1
    s_lang, t_lang = (like >> 4) & 15, (t_sig >> 7) & 15
    has = (target >= 0) & (target < LANG_BITS)
    at = np.where(has, target, 0)
    end, s_end = (t_sig >> 4) & 7, (s_sig >> 4) & 3
    e = {x: end == k for k, x in enumerate(ENDINGS)}
    s = {x: s_end == k for k, x in enumerate(SOURCE_ENDINGS)}
    per = np.ones(len(at))
    for x, v in CHARS_PER.items():
        per[has & (at == LANGS.index(x))] = v
    ratio = (t_len / per) / np.maximum(1.0, s_len / np.where(bit(s_sig, 3) == 1, 0.4, 1.0))
    one = (s_lang == t_lang) & (s_lang != NO_LANG)
    # what stays as it is because it already is in the wanted language is no copy
    repeats = (bit(like, 0) == 1) | one
    repeats &= ~(has & (s_lang == at) & (bit(like, 3) == 1))
    cast = [
        bit(t_sig, 0) == 0, bit(t_sig, 1) == 0, t_len <= 2,
        (bit(t_sig, 2) == 1) & ~((bit(s_sig, 1) == 1) & (target >= 0)), (bit(t_sig, 3) == 1) & (bit(s_sig, 2) == 0), (ratio < 0.6) | (ratio > 1.7),
        repeats & (bit(like, 0) == 1), repeats & (bit(like, 1) == 1), repeats & (bit(like, 2) == 1),
        has & (bit(t_sig >> 12, at) == 1), has & (bit(t_sig >> (12 + LANG_BITS), at) == 1), one & has & (t_lang != at),
        e["open"] | e["noise"] | (e["pause"] & (s["sentence"] | s["title"])) | (e["short"] & (s["sentence"] | s["pause"])),
        e["open"] | e["noise"] | e["pause"] | e["short"] | e["thai"], e["noise"], ratio < 0.6,
    ]
    return sum(np.asarray(v).astype(np.int64) << k for k, v in enumerate(cast)) if len(at) else np.zeros(0, np.int64)


def pattern_of(src: str, tgt: str | None, target: str | None, profiles: Profiles) -> int:
    """The vote pattern of one pair."""
    return int(patterns_of([Planted(src, tgt, target, None)], profiles)[0])


def target_number(code: Column) -> Column:
    """Number of a language code among LANGS, NO_LANG for other codes, -1 for none."""
    known = F.create_map(*[x for k, v in enumerate(LANGS) for x in (F.lit(v), F.lit(k))])
    return F.coalesce(known[code], F.when(code.isNotNull(), F.lit(NO_LANG)), F.lit(-1)).cast("int")


SIDES = "s_sig bigint, s_len int, t_sig bigint, t_len int, `like` int"


def both_sides(segments: DataFrame, profiles: Profiles) -> DataFrame:
    """id, job_id and SIDES of every segment with a text that has words and a translation: both are in one row.

    Texts of different scripts aren't compared: they have neither letters nor language in common.
    """
    shared = segments.sparkSession.sparkContext.broadcast(profiles)  # at most 11 languages x TOP n-grams
    rows = segments.where("text is not null and translated is not null").select("text", "translated", F.col("segment_id").cast("bigint").alias("id"), F.col("job_id").cast("string").alias("job_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in (x.slice(at, 2048) for x in batches for at in range(0, x.num_rows, 2048)):
            s = sources_seen(b.column(0).to_pylist())
            b = b.take(pa.array([i for i, x in enumerate(s) if x[0]], pa.int64()))
            s = [x for x in s if x[0]]
            src, tgt = b.column(0).to_pylist(), b.column(1).to_pylist()
            t = answers_seen(tgt, model)
            like = [APART] * len(s)
            if s:
                near = np.flatnonzero((scripts_of(src).argmax(axis=1) == scripts_of(tgt).argmax(axis=1)) & np.array([bool(x) for x in tgt])).tolist()
                for i, x in zip(near, compared([src[i] for i in near], [tgt[i] for i in near], model)):
                    like[i] = x
            cols = [b.column(2), b.column(3), pa.array([x[0] for x in s], pa.int64()), pa.array([x[1] for x in s], pa.int32()), pa.array([x[0] for x in t], pa.int64()), pa.array([x[1] for x in t], pa.int32()), pa.array(like, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "job_id", "s_sig", "s_len", "t_sig", "t_len", "like"])

    return spread(rows).mapInArrow(run, "id bigint, job_id string, " + SIDES)


def one_side(df: DataFrame, text: str, keep: list[str], seen, p: str) -> DataFrame:  # noqa: ANN001
    """The columns ``keep`` with what ``seen`` sees in a text: {p}_sig, {p}_len."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + f", {p}_sig bigint, {p}_len int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 2048) for x in batches for at in range(0, x.num_rows, 2048)):
            got = list(zip(*seen(b.column(0).to_pylist()))) or [(), ()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got[0], pa.int64()), pa.array(got[1], pa.int32())], names=[*keep, f"{p}_sig", f"{p}_len"])

    return spread(df.select(text, *keep)).mapInArrow(run, schema)


FETCHED = 2_000_000  # ids that may be broadcast to fetch their texts; more are joined by a shuffle


def fetched(df: DataFrame, ids: DataFrame, column: str, few: bool) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among ``ids``; these are broadcast only if they are few."""
    ids = ids.select(column).distinct()
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi")


def asked_and_answered(requests: DataFrame, results: DataFrame, profiles: Profiles) -> DataFrame:
    """id, target and SIDES of every result whose request has a text with words.

    Of a request that was sent several times the text sent last counts (by received_at; of equal times the greater hash). A null
    translation is a pair. The request's id is a hash of 96 bits in the shuffles.
    """
    shared = requests.sparkSession.sparkContext.broadcast(profiles)  # at most 11 languages x TOP n-grams
    key = lambda c: (F.xxhash64(c).alias("k64"), F.hash(c).alias("k32"))
    asked = requests.where("request_id is not null and text is not null").select("text", *key("request_id"), F.col("received_at").alias("sent"), F.xxhash64("text").alias("s_hash"))
    s = one_side(asked, "text", ["k64", "k32", "sent", "s_hash"], sources_seen, "s")
    s = s.groupBy("k64", "k32").agg(F.max(F.struct("sent", "s_hash", "s_sig", "s_len")).alias("s")).select("k64", "k32", "s.s_sig", "s.s_len", "s.s_hash").where("s_sig <> 0")
    answered = results.where("request_id is not null").select("translated_text", F.col("result_id").cast("bigint").alias("id"), *key("request_id"), target_number(label_code(F.col("target_language"))).alias("target"))
    t = one_side(answered, "translated_text", ["id", "k64", "k32", "target"], lambda texts: answers_seen(texts, shared.value), "t")
    both = cut(t.join(s, ["k64", "k32"]))
    t_lang = F.shiftright("t_sig", 7).bitwiseAND(15)
    settled = (F.col("target") == t_lang) & (F.shiftright("t_sig", 11).bitwiseAND(1) == 1)
    near = cut(both.where((F.col("t_len") > 0) & ~settled).select("id", "k64", "k32", "s_hash"))
    few = near.count() <= FETCHED
    texts = fetched(answered.select("id", "k64", "k32", "translated_text"), near, "id", few).where("translated_text is not null").join(near.select("id", F.col("s_hash").alias("want")).distinct(), "id")
    sources = fetched(asked.select("text", "k64", "k32", "s_hash"), near, "k64", few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 2048) for x in batches for at in range(0, x.num_rows, 2048)):
            like = compared(b.column(1).to_pylist(), b.column(2).to_pylist(), shared.value) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(like, pa.int32())], names=["id", "like"])

    pairs = sources.join(texts, ["k64", "k32"]).where("s_hash = want").select("id", "text", "translated_text")
    like = pairs.mapInArrow(run, "id bigint, `like` int").groupBy("id").agg(F.max("like").alias("near"))
    got = both.join(like, "id", "left").withColumn("like", F.coalesce("near", F.lit(APART)).cast("int"))
    return got.select("id", "target", *[F.col(c) for c in FIELDS])


def voted(segments: DataFrame, configs: DataFrame, requests: DataFrame, results: DataFrame, profiles: Profiles) -> DataFrame:
    """pair_table, pair_id, pattern (the votes as bits) of every pair whose source has words outside addresses and file names.

    A null segments.translated is not yet translated and no pair; a null results.translated_text is one. A result without a request,
    or with a request without text, has no source and is no pair. All results of a request count. Repeated rows stay.
    """
    jobs = configs.where("job_id is not null").groupBy("job_id").agg(F.max(label_code(F.col("target"))).alias("code"))
    seg = both_sides(segments, profiles)
    # null jobs match nothing: their rows are kept aside instead of meeting in one partition
    own = seg.where("job_id is not null").join(jobs, "job_id", "left").select(F.lit("segment").alias("pair_table"), "id", target_number(F.col("code")).alias("target"), *FIELDS)
    none = seg.where("job_id is null").select(F.lit("segment").alias("pair_table"), "id", F.lit(-1).alias("target"), *FIELDS)
    res = asked_and_answered(requests, results, profiles).select(F.lit("result").alias("pair_table"), "id", "target", *FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 8)]
            bits = votes(*(c.astype(np.int64) for c in (x[1], x[2], x[3], x[4], x[5], x[0])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.int64())], names=["pair_table", "pair_id", "pattern"])

    return own.unionByName(none).unionByName(res).mapInArrow(run, "pair_table string, pair_id bigint, pattern bigint")


FIELDS = ("s_sig", "s_len", "t_sig", "t_len", "like")

# ---- planted defects

PLANTED, PLANTED_LENGTH = 400, 2000  # pairs into which defects are planted at most, and their greatest length: the documented bounds
# Answers that decline, for planting. Fixed values.
DECLINING = (
    "I'm sorry, but I can't translate this text.", "Unfortunately, this request cannot be processed.", "К сожалению, я не могу перевести этот текст.", "Leider kann ich diesen Text nicht übersetzen.",
    "Lo siento, no puedo traducir este texto.", "Désolé, je ne peux pas traduire ce texte.", "抱歉，我无法翻译这段文字。", "申し訳ありませんが、この文章は翻訳できません。", "As an AI language model, I cannot help with that.",
)


@dataclass
class Planted:
    """A pair with a planted defect, or none, and its target language."""

    src: str
    tgt: str
    target: str
    defect: str | None


def plant(rows: list[tuple[str, str, str]]) -> list[Planted]:
    """Pairs with each defect planted in turn, and the pairs as they are, from pairs of source, translation and target."""
    out = []
    for k, (s, t, g) in enumerate(rows):
        other = next((u for u, h in ((rows[(k + d) % len(rows)][1], rows[(k + d) % len(rows)][2]) for d in range(1, len(rows))) if h != g), None)
        lead = ("Translation: ", "Перевод: ", "")[k % 3]
        made = {"empty": ("", " ", "\u200b", "\n")[k % 4], "refusal": DECLINING[k % len(DECLINING)], "copy": (s, s.upper(), lead + s, s.rstrip(".。!?"), "".join(c for i, c in enumerate(s) if (i + 7) % 40))[k % 5], "wrong_language": other, "truncated": broken(t, k)}
        out.append(Planted(s, t, g, None))
        out += [Planted(s, x, g, d) for d, x in made.items() if x is not None and x != t]
    return out


def broken(text: str, k: int) -> str | None:
    """A text cut inside its last sentence, or null if it has no sentence of enough words to be cut."""
    if ending(text) != "done" or len(text) < 24:
        return None
    cut_at = len(text) * (50 + 7 * k % 40) // 100
    piece = text[:cut_at].rstrip()
    return (piece + ("", "", "…", "&am")[k % 4]) if ending(piece) in ("open", "short") else None


def sample(segments: DataFrame, configs: DataFrame) -> list[tuple[str, str, str]]:
    """(source, translation, target) of PLANTED pairs at most, chosen by the hash of the segment's id; copies are left out."""
    jobs = configs.where("job_id is not null").groupBy("job_id").agg(F.max(label_code(F.col("target"))).alias("code")).where(F.col("code").isin(*LANGS))
    fit = segments.select("segment_id", "job_id", "text", "translated").where(F.col("text").isNotNull() & (F.length("translated") > 0) & (F.length("text") <= PLANTED_LENGTH) & (F.length("translated") <= PLANTED_LENGTH) & (F.col("text") != F.col("translated")))
    # the hash is ranked before the texts are joined: ids of twice as many rows, as some have no job
    some = fit.select("segment_id", "job_id", F.xxhash64("segment_id").alias("h")).join(jobs, "job_id").orderBy("h", "segment_id").limit(PLANTED)
    rows = fit.join(F.broadcast(some.select("segment_id", "code", "h")), "segment_id").select("h", "segment_id", "text", "translated", "code").collect()  # PLANTED rows
    return [(r.text, r.translated, r.code) for r in sorted(rows, key=lambda r: (r.h, r.segment_id, r.text, r.translated))[:PLANTED]]


def patterns_of(rows: list[Planted], profiles: Profiles) -> np.ndarray:
    """The vote patterns of planted pairs."""
    s, t = sources_seen([r.src for r in rows]), answers_seen([r.tgt for r in rows], profiles)
    like = compared([r.src for r in rows], [r.tgt or "" for r in rows], profiles) if rows else []
    target = [LANGS.index(r.target) if r.target in LANGS else NO_LANG if r.target else -1 for r in rows]
    col = lambda x: np.array(list(x), dtype=np.int64)
    return votes(col(x[0] for x in s), col(x[1] for x in s), col(x[0] for x in t), col(x[1] for x in t), col(like), col(target))


# ---- label model


@dataclass
class LabelModel:
    """Prior, hit and false-alarm rates of each defect's functions, and the cutoff of its posterior."""

    prior: dict[str, float]
    hit: dict[str, np.ndarray]
    false: dict[str, np.ndarray]
    cutoff: dict[str, float]

    def posterior(self, keys: np.ndarray, defect: str) -> np.ndarray:
        x = bits_of(keys, defect)
        yes = self.prior[defect] * np.prod(np.where(x == 1, self.hit[defect], 1 - self.hit[defect]), axis=1)
        no = (1 - self.prior[defect]) * np.prod(np.where(x == 1, self.false[defect], 1 - self.false[defect]), axis=1)
        return yes / np.maximum(yes + no, 1e-300)

    def labels(self, key: int) -> dict[str, float]:
        """Defects that a pattern keeps, with their posteriors."""
        p = {d: float(self.posterior(np.array([key]), d)[0]) for d in DEFECTS}
        return {d: v for d, v in p.items() if v > self.cutoff[d]}


def bits_of(keys: np.ndarray, defect: str) -> np.ndarray:
    begin = 0
    for d, fs in FUNCTIONS.items():
        if d == defect:
            return np.stack([(keys >> (begin + i)) & 1 for i in range(len(fs))], axis=1) if len(keys) else np.zeros((0, len(fs)), np.int64)
        begin += len(fs)
    raise KeyError(defect)


def label_model(patterns: dict[int, int], planted: list[tuple[int, str | None]] = (), rounds: int = 40) -> LabelModel:
    """Expectation-maximization over the counts of all pairs' patterns and the labelled patterns of ``planted``.

    Of the planted pairs every second one teaches, with its label as its posterior; a pair without a planted defect teaches nothing,
    for it may have one of its own. The rates are free; only a few imagined pairs with the starting rates stand for what no pair
    shows. The other half of the planted pairs gives the cutoffs: for each defect the middle of the widest gap between posteriors
    at which most planted defects are kept and fewest other pairs.
    """
    keys = np.array(sorted(patterns), dtype=np.int64)
    n = np.array([patterns[int(k)] for k in keys], dtype=float)
    model = LabelModel({}, {}, {}, {})
    teach, check = list(planted[::2]), list(planted[1::2])
    for defect, fs in FUNCTIONS.items():
        own = np.array([k for k, d in teach if d == defect], dtype=np.int64)
        x, y = bits_of(keys, defect), bits_of(own, defect)
        start_hit, start_false = np.array([f[1] for f in fs]), np.array([f[2] for f in fs])
        model.prior[defect], model.hit[defect], model.false[defect] = 0.03, start_hit, start_false
        for _ in range(rounds):
            post = model.posterior(keys, defect)
            a, b = float((n * post).sum()), float((n * (1 - post)).sum())
            # four imagined defective pairs and a hundred sound ones with the starting rates
            hit = (((n * post)[:, None] * x).sum(axis=0) + y.sum(axis=0) + 4 * start_hit) / (a + len(y) + 4)
            false = (((n * (1 - post))[:, None] * x).sum(axis=0) + 100 * start_false) / (b + 100)
            model.hit[defect], model.false[defect] = np.clip(hit, 0.001, 0.9999), np.clip(false, 1e-6, 0.9)
            model.prior[defect] = float(np.clip((a + 0.6) / (a + b + 20), 1e-3, 0.6))
        model.cutoff[defect] = cutoff(model, defect, check)
    return model


def cutoff(model: LabelModel, defect: str, check: list[tuple[int, str | None]]) -> float:
    """The posterior above which held-out pairs with the defect planted are best told from the others; one half without any.

    A copy or a refusal may truly be in a wrong language or unfinished too, so these tell nothing against the later defects.
    """
    rank = DEFECTS.index(defect)
    good = model.posterior(np.array([k for k, d in check if d == defect], np.int64), defect)
    bad = model.posterior(np.array([k for k, d in check if d is None or DEFECTS.index(d) > rank], np.int64), defect)
    if not len(good):
        return 0.5
    places = np.unique(np.concatenate(([0.0, 1.0], good, bad)))
    best, at = (-2.0, 0.0), 0.5
    for lo, hi in zip(places, places[1:]):
        worth = ((good >= hi).mean() - (bad >= hi).mean() if len(bad) else (good >= hi).mean(), hi - lo)
        if worth > best:
            best, at = worth, float((lo + hi) / 2)
    return at


def defects(segments: DataFrame, configs: DataFrame, requests: DataFrame, results: DataFrame, documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """pair_table, pair_id, defects (all above their cutoffs), posteriors of every pair that keeps a defect."""
    profiles = train(documents, common_words)
    got = cut(voted(segments, configs, requests, results, profiles))
    counts = {r.pattern: r.n for r in got.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # at most 2^16 patterns
    rows = plant(sample(segments, configs))
    known = patterns_of(rows, profiles)
    model = label_model(counts, [(int(k), r.defect) for k, r in zip(known, rows)])
    kept = [(k, p) for k in sorted(counts) if (p := model.labels(k))]
    table = got.sparkSession.createDataFrame([(k, list(p), [round(v, 6) for v in p.values()]) for k, p in kept], "pattern bigint, defects array<string>, posteriors array<double>")
    return got.join(small(table), "pattern").select("pair_table", "pair_id", "defects", "posteriors")


def first_defect(found: DataFrame) -> DataFrame:
    """pair_table, pair_id, defect: the one that is named for a pair."""
    return found.select("pair_table", "pair_id", F.col("defects")[0].alias("defect")).distinct()
