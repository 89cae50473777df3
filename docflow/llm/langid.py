"""Language of texts and of their stretches by rank-order profiles (problem 1).

A profile is the list of a language's most frequent character n-grams in order of frequency. A sentence's own n-grams are
ranked in the same way, and its out-of-place distance to each profile is the sum of the differences of rank, an n-gram that
a profile lacks counting as the worst. The nearest profile wins; the confidence is the relative lead over the next one.
All sentences of a batch are measured at once on arrays of code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.langs import LANGS, label_code
from docflow.llm.quality import junk_kind
from docflow.llm.sentences import FILE_ENDS
from docflow.llm.tables import spread, spread_nulls

ORDERS = (1, 2, 3)
PART = 400_000  # characters measured together
ROWS = 1024  # texts of a batch handled together
TOP = 500  # n-grams of a profile
SAMPLE = 600  # training texts of a language: the documented bound of the sample
LEAST_LETTERS = 12  # letters of a sentence that may show a language of its own (a CJK letter counts three)
LEAST_LEAD = 0.95  # letters times lead of a text's nearest language below which common words decide between the near ones
OTHER = "und"  # a language that has no profile
# A text is in another language if it has enough letters, and its sentences are far from all profiles and hardly nearer to one than to the next.
OTHER_LETTERS, OTHER_FAR, OTHER_LEAD = 100, 0.45, 0.1
LEAST_EVIDENCE = 1.3  # letters times lead over the text's main language that make a sentence foreign to it

NOT_WORDS = re.compile(
    r"(?i)(?:https?://|www\.|mailto:)[^\s<>　-ヿ一-鿿]+|(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<![\w-])[\w-]+\.(?:" + "|".join(FILE_ENDS) + r")(?![A-Za-z])"
    r"|«[^«»]{1,40}»|“[^“”]{1,40}”|„[^„“]{1,40}“|「[^「」]{1,40}」|\"[^\"\n]{1,40}\"|\[[A-Z]{2,5}\]"
)
QUOTE_MARKS = re.compile("[«»“”„「」\"']")
HAS_OTHER = re.compile(r"[/@«“„「\"\[]|\.[A-Za-z]")
# The ranges of code points of each script. Fixed values.
RANGES = {"th": ((0x0E00, 0x0E7F),), "hi": ((0x0900, 0x097F),), "kana": ((0x3040, 0x30FF), (0xFF66, 0xFF9F)), "han": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x2F00, 0x2FDF)), "cyr": ((0x0400, 0x052F),), "lat": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))}
SCRIPTS = ("lat", "cyr", "han", "kana", "hi", "th")
KIND_OF = {"ru": 1, "uk": 1, "zh": 2, "ja": 2, "hi": 3, "th": 4}  # 0: Latin
SCRIPT_TABLE = np.zeros(0x110000, dtype=np.uint8)
for _k, _s in enumerate(SCRIPTS, 1):
    for _a, _b in RANGES[_s]:
        SCRIPT_TABLE[_a : _b + 1] = _k
SCRIPT_TABLE[[0xD7, 0xF7]] = 0
FOLD = np.arange(0x110000, dtype=np.uint32)
FOLD[0xFF21:0xFF3B] = np.arange(0x61, 0x7B)
FOLD[0xFF41:0xFF5B] = np.arange(0x61, 0x7B)


def script_kind(counts: np.ndarray) -> np.ndarray:
    """Script of most letters: 0 Latin, 1 Cyrillic, 2 Chinese and Japanese, 3 Devanagari, 4 Thai."""
    lat, cyr, han, kana, hi, th = counts.T
    return np.argmax(np.stack([lat, cyr, (han + kana) * 2, hi, th]), axis=0)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram code) of every n-gram, and counts of letters by script for every text.

    A word is a run of letters with a blank at either side; an n-gram's code holds up to three code points of 21 bits.
    """
    joined = "\0".join(texts).lower() + "\0"
    cp = FOLD[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    owner = np.cumsum(cp == 0) - (cp == 0)
    script = SCRIPT_TABLE[cp]
    n = int(owner[-1]) + 1
    counts = np.bincount(owner * 8 + script, minlength=n * 8).reshape(n, 8)[:, 1:7]
    keep = script > 0
    # a blank stands for each run of other characters
    edge = keep | np.concatenate(([True], keep[:-1]))
    code = np.where(keep, cp, 32).astype(np.int64)[edge]
    own = owner[edge]
    single = code >= 0x3000  # single letters tell something only where they are whole syllables or words
    parts = [(own[single], code[single])]
    for k in (2, 3):
        if len(code) < k:
            continue
        c = code[: len(code) - k + 1].copy()
        ok = own[: len(own) - k + 1] == own[k - 1 :]
        for j in range(1, k):
            nxt = code[j : len(code) - k + 1 + j]
            c = (c << 21) | nxt
            if j < k - 1:
                ok &= nxt != 32  # no blank inside
        if k == 2:
            ok &= ~((code[:-1] == 32) & (code[1:] == 32))
        parts.append((own[: len(ok)][ok], c[ok]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), counts


UNKNOWN = 1 << 15  # numbers from which an n-gram is in no profile
FEW = 32  # counts below it are ranked by counting, without a sort


def ranked(owner: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Rank of each n-gram of a text by its count, the greatest first; equal counts share the middle one of their ranks.

    ``owner`` is sorted. Texts with a count of FEW or more are sorted by count, the others need no sort.
    """
    small = np.minimum(count, FEW)
    held = np.bincount(owner * (FEW + 1) + small, minlength=n * (FEW + 1)).reshape(n, FEW + 1)
    above = held[:, ::-1].cumsum(axis=1)[:, ::-1] - held
    rank = (above + (held - 1) / 2)[owner, small]
    many = np.flatnonzero(small == FEW)  # all of them rank before the others: only they are sorted
    if len(many):
        many = many[np.lexsort((-count[many], owner[many]))]
        o, c = owner[many], count[many]
        new = np.concatenate(([True], (o[1:] != o[:-1]) | (c[1:] != c[:-1])))
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(many)))
        text = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        base = np.repeat(text, np.diff(np.append(text, len(many))))
        rank[many] = np.repeat(begin + (size - 1) / 2, size) - base
    return rank


@dataclass
class Profiles:
    """Sorted n-gram codes and, for each, its rank in every language (TOP if absent)."""

    codes: np.ndarray
    ranks: np.ndarray
    langs: tuple[str, ...]
    words: dict[str, frozenset[str]] = field(default_factory=dict)  # common words, for texts that lie equally near to several profiles

    def __post_init__(self) -> None:
        # a table of hashes without collisions among the profiles' codes: one look instead of a search
        self.bits = 22
        for k in range(1, 400):
            factor = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
            slots = self.slot(self.codes, factor)
            if len(np.unique(slots)) == len(self.codes):
                self.factor = factor
                break
        else:
            raise ValueError("no hash without collisions")
        self.table = np.zeros(1 << self.bits, np.int16)
        self.table[slots] = np.arange(len(self.codes), dtype=np.int16)

    def slot(self, codes: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (codes.astype(np.uint64) * factor) >> np.uint64(64 - self.bits)

    def __reduce__(self):
        return Profiles, (self.codes, self.ranks, self.langs, self.words)

    @classmethod
    def of(cls, tops: dict[str, list[int]], words: dict[str, set[str]] | None = None) -> Profiles:
        langs = tuple(x for x in LANGS if tops.get(x))
        codes = np.unique(np.concatenate([np.array(tops[x], np.int64) for x in langs])) if langs else np.zeros(0, np.int64)
        ranks = np.full((len(codes) + 1, len(langs)), TOP, np.float32)  # the last row: in no profile
        for j, x in enumerate(langs):
            ranks[np.searchsorted(codes, np.array(tops[x], np.int64)), j] = np.arange(len(tops[x]))
        return cls(codes, ranks, langs, {x: frozenset(w) for x, w in (words or {}).items() if x in langs})

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean out-of-place distance of each text to each language as a share of the worst; letters by script.

        A text's different n-grams are ranked by their counts, those of equal count sharing the middle one of their ranks, and its
        TOP most frequent ones are compared. One that a profile lacks is worst for the language; so are all n-grams for languages
        of another script than most of the text's letters. A text repeated keeps its ranks and so its distances.
        """
        n, size = len(texts), len(self.codes)
        owner, code, counts = grams(texts)
        counts = counts[:n]
        out = np.ones((n, len(self.langs)), np.float32)
        if not size:
            return out, counts
        at = self.table[self.slot(code, self.factor)]
        known = self.codes[at] == code
        # one number for each n-gram of a text: its place among the profiles' ones, or a hash beyond them
        other = UNKNOWN + ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
        key = np.sort((owner << 33) | np.where(known, at, other))
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        o, c = key[first] >> 33, key[first] & ((1 << 33) - 1)
        rank = ranked(o, count, n)
        used = rank < TOP
        missing = np.bincount(o[used & (c >= UNKNOWN)], minlength=n)
        held = np.flatnonzero(used & (c < UNKNOWN))
        o, c, rank = o[held], c[held], rank[held].astype(np.float32)
        kind, groups = script_kind(counts)[o], {}
        for j, x in enumerate(self.langs):
            groups.setdefault(KIND_OF.get(x, 0), []).append(j)
        for k, js in groups.items():
            sel = np.flatnonzero(kind == k)
            if not len(sel):
                continue
            apart = self.ranks[np.ix_(c[sel], js)] if len(js) > 1 else self.ranks[c[sel], js[0]][:, None]
            absent = apart >= TOP
            apart -= rank[sel, None]
            np.abs(apart, out=apart)
            apart[absent] = TOP
            own = o[sel]
            start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            rows = own[start]
            sums = np.add.reduceat(apart, start, axis=0) / TOP + missing[rows, None]
            out[np.ix_(rows, js)] = sums / (np.diff(np.append(start, len(own))) + missing[rows])[:, None]
        return out, counts

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``measure_part``, in parts of bounded size, so that a batch of long texts needs little memory."""
        ends = np.cumsum([len(t) + 1 for t in texts]) // PART
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)] if len(texts) else [0, 0]
        if len(cuts) == 2:
            return self.measure_part(texts)
        got = [self.measure_part(texts[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def measure_part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each text to each language, more than 1 for another script; letters of each text."""
        far, counts = self.distances(texts)
        kind = script_kind(counts)
        japanese = counts[:, 3] * 8 >= counts[:, 2] + counts[:, 3]
        for j, x in enumerate(self.langs):
            fits = kind == KIND_OF.get(x, 0)
            if x in ("zh", "ja"):
                fits &= japanese == (x == "ja")
            far[:, j] += np.where(fits, 0, 1)  # another script is worse than any rank
        letters = counts.sum(axis=1)
        return far, np.where(kind == 2, letters * 3, letters)


def training_texts(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(lang, text) of at most about SAMPLE documents of each declared language.

    A document counts if the common words of its declared language are the most frequent in it or its script has one language
    only, so that wrong labels don't spoil a profile. Rows are taken by the hash of the id, at a rate from the languages' counts.
    """
    lang = label_code(F.col("lang"))
    known = documents.select("doc_id", "text", lang.alias("lang")).where("lang is not null and length(text) >= 80")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    rate = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return known.join(F.broadcast(counts), "lang").where(part < rate).select("lang", "text")


def train(documents: DataFrame, common_words: DataFrame) -> Profiles:
    """Profiles from a bounded sample of labelled documents; the common words alone stand in for a language without documents."""
    words = {}
    for r in common_words.select("lang", "word").where("lang is not null and word is not null").collect():  # a fixed table
        words.setdefault(r.lang, set()).add(r.word.lower())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, pd.Series] = {}
        for b in batches:
            for lang, texts in pd.DataFrame({"l": b.column(0).to_pylist(), "t": b.column(1).to_pylist()}).groupby("l").t:
                good = [NOT_WORDS.sub(" ", t) for t in texts if plausible(t, lang, words)] if lang in LANGS else []
                for at in range(0, len(good), 128):
                    _, code, _ = grams(good[at : at + 128])
                    code, n = np.unique(code, return_counts=True)
                    s = pd.Series(n, index=code)
                    sums[lang] = s.add(sums[lang], fill_value=0) if lang in sums else s
        for lang, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s)), pa.array(s.index.to_numpy(), pa.int64()), pa.array(s.to_numpy().astype("int64"))], names=["lang", "code", "n"])

    total = training_texts(documents, common_words).mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # one struct array per language, bounded by TOP: ranks in the sample, which is bounded too
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = total.withColumn("r", F.row_number().over(w)).where(F.col("r") <= TOP).collect()
    tops: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.r)):
        tops.setdefault(r.lang, []).append(r.code)
    for lang in LANGS:
        if len(tops.get(lang, [])) < TOP // 4 and words.get(lang):
            _, code, _ = grams([" ".join(sorted(words[lang]))])
            more = pd.Series(1, index=code).groupby(level=0).sum().sort_values(ascending=False, kind="stable").index.tolist()
            have = tops.get(lang, [])
            tops[lang] = (have + [c for c in more if c not in set(have)])[:TOP]
    return Profiles.of(tops, words)


WORD = re.compile(r"[^\W\d_]+", re.U)


def plausible(text: str, lang: str, words: dict[str, set[str]]) -> bool:
    """Whether a text's common words don't speak against its label."""
    script = {"ru": "Ѐ-ӿ", "uk": "Ѐ-ӿ", "zh": "一-鿿", "ja": "぀-ヿ", "hi": "ऀ-ॿ", "th": "฀-๿"}.get(lang, "A-Za-zÀ-ɏ")
    letters = len(re.findall(r"[^\W\d_]", text))
    own = len(re.findall(f"[{script}]", text))
    if own < (0.2 if lang == "ja" else 0.75) * letters or letters < 0.4 * len(text.replace(" ", "")):
        return False
    if lang == "zh" and re.search("[぀-ヿ]{2}", text):
        return False
    if lang in ("zh", "ja", "hi", "th") or lang not in words:
        return True
    tokens = WORD.findall(text.lower())
    hits = {x: sum(t in w for t in tokens) for x, w in words.items()}
    return hits[lang] > 0 and hits[lang] >= max(hits.values())


@dataclass
class Found:
    """Language of a text: main one, confidence, languages that have whole sentences, and stretches (start, end, language, confidence)."""

    lang: str | None
    confidence: float
    mixed: list[str]
    stretches: list[tuple[int, int, str, float]]


# A line break before a small letter only wraps a sentence, unless the line above is empty.
CUT = re.compile(r"[.!?…。！？।॥\n\r](?:(?<=[。！？।॥])[”」』’]*|(?<=[\n\r])(?:(?<=[\n\r][\n\r])|(?![a-zà-ÿа-яёіїєґ]))|[\"'”’»)]*(?:(?<![\n\r])\s+|(?<![\n\r])(?=[^\W\d_a-z])))")
CUT_THAI = re.compile(CUT.pattern + r"|(?<=[฀-๿])\s+|\s+(?=[฀-๿])")
HAS_THAI = re.compile("[฀-๿]")


def pieces(text: str) -> list[tuple[int, int]]:
    """Rough sentences: too fine a cut only gives pieces that show no language of their own."""
    ends = [m.end() for m in (CUT_THAI if HAS_THAI.search(text) else CUT).finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def identify(texts: list[str], profiles: Profiles) -> list[Found]:
    """Language of each text and of each stretch of sentences of one language; equal sentences are measured once."""
    cuts: list[list[tuple[int, int]]] = [pieces(t) if t else [] for t in texts]
    flat = [t[a:b] for t, p in zip(texts, cuts) for a, b in p]
    if not flat or not profiles.langs:
        return [Found(None, 0.0, [], []) for _ in texts]
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    far, letters = profiles.measure([NOT_WORDS.sub(" ", x) if HAS_OTHER.search(x) else x for x in distinct])
    far, letters = far[codes], letters[codes]
    # per text: letters-weighted distance to each language; the nearest is the main one
    sizes = np.array([len(p) for p in cuts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    total = np.stack([np.bincount(owner, weights=far[:, j] * letters, minlength=len(texts)) for j in range(far.shape[1])], axis=1)
    weight = np.bincount(owner, weights=letters, minlength=len(texts))
    main = np.argmin(total, axis=1)
    settle(texts, total, weight, main, profiles)
    bare = [i for i in np.flatnonzero(weight == 0) if QUOTE_MARKS.search(texts[i])]
    # a text that is nothing but quoted words is read without its quotation marks
    reread = dict(zip(bare, identify([QUOTE_MARKS.sub(" ", texts[i]) for i in bare], profiles))) if bare else {}
    best = np.argmin(far, axis=1)
    rows = np.arange(len(far))
    evidence = (far[rows, main[owner]] - far[rows, best]) * letters
    foreign = (evidence >= LEAST_EVIDENCE) & (letters >= LEAST_LETTERS)
    other = far.copy()
    other[rows, best] = 9
    lead = np.clip((other.min(axis=1) - far[rows, best]) / np.maximum(other.min(axis=1), 1e-6), 0, 1)
    clear = foreign | ((best == main[owner]) & (letters >= LEAST_LETTERS))
    own = np.where(foreign, best, main[owner])
    # where a text has several foreign languages, each must also be nearer than the others that the text is known to have
    doubtful = np.flatnonzero(np.bincount(owner, weights=foreign, minlength=len(texts)) > 1)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    for i in doubtful:
        part = slice(begin[i], begin[i + 1])
        names, peak = np.unique(own[part][foreign[part]]), None
        if len(names) < 2:
            continue
        f, w, o, g = far[part], letters[part], own[part], foreign[part]
        peak = [float((evidence[part] * (g & (o == k))).max()) for k in names]
        accepted = [int(main[i])]
        for _, k in sorted(zip(peak, names.tolist()), reverse=True):
            mine = g & (o == k)
            better = (f[:, accepted].min(axis=1) - f[:, k]) * w >= LEAST_EVIDENCE
            if (mine & better).any():
                accepted.append(k)
            else:
                back = np.array(accepted)[np.argmin(f[:, accepted], axis=1)]
                own[part] = np.where(mine, back, o)
                o = own[part]
    mean = lambda x: np.bincount(owner, weights=x * letters, minlength=len(texts)) / np.maximum(weight, 1)
    foreign_text = (weight >= OTHER_LETTERS) & (mean(far[rows, best]) >= OTHER_FAR) & (mean(lead) < OTHER_LEAD)
    out, at = [], 0
    for i, p in enumerate(cuts):
        if foreign_text[i]:
            out.append(Found(OTHER, 0.0, [], [(p[0][0], p[-1][1], OTHER, 0.0)]))
            at += len(p)
            continue
        out.append(reread[i] if i in reread else joined(p, weight[i], main[i], own[at : at + len(p)], clear[at : at + len(p)], lead[at : at + len(p)], letters[at : at + len(p)], profiles.langs))
        at += len(p)
    return out


def settle(texts: list[str], total: np.ndarray, weight: np.ndarray, main: np.ndarray, profiles: Profiles) -> None:
    """Where a text is about as near to other languages as to its nearest one, the one with the most common words in it takes its place."""
    if not profiles.words or total.shape[1] < 2:
        return
    least = total[np.arange(len(texts)), main]
    near = total - least[:, None] < LEAST_LEAD
    for i in np.flatnonzero((near.sum(axis=1) > 1) & (weight > 0)):
        found = WORD.findall(texts[i].lower())
        hits = {int(j): sum(w in profiles.words.get(profiles.langs[j], ()) for w in found) for j in np.flatnonzero(near[i])}
        best = max(hits, key=lambda j: (hits[j], j == main[i], -total[i, j]))
        main[i] = best


def joined(p, weight, main, own, clear, lead, letters, names) -> Found:
    """Neighbouring sentences of one language become a stretch; those without a language of their own take the main one."""
    if not len(p) or not weight:
        return Found(None, 0.0, [], [])
    mixed = []
    if len(p) > 1 and (own[clear] != main).any():
        mixed = [names[k] for k in np.unique(own[clear])]
    if len(mixed) <= 1:
        if mixed:
            main, mixed = int(own[clear][0]), []
        sure = round(min(1.0, 2 * float((lead * letters).sum() / weight)), 4)
        return Found(names[main], sure, [], [(p[0][0], p[-1][1], names[main], sure)])
    stretches: list[list] = []
    for (a, b), k, d, w in zip(p, own, lead, letters):
        if stretches and stretches[-1][2] == names[k]:
            stretches[-1][1] = b
            stretches[-1][3] += d * w
            stretches[-1][4] += w
        else:
            stretches.append([a, b, names[k], d * w, w])
    share = float(letters[own == main].sum()) / weight
    return Found(names[main], round(share, 4), mixed, [(a, b, x, round(min(1.0, 2 * float(d) / max(float(w), 1.0)), 4)) for a, b, x, d, w in stretches])


LANG_ROW = "lang string, confidence double, mixed array<string>, junk string, stretches array<struct<start:int,stop:int,lang:string,confidence:double>>"


def languages(df: DataFrame, text: str, profiles: Profiles, *keep: str, junk=True) -> DataFrame:
    """The columns ``keep`` of every row of ``df`` with the language of its text, its stretches and its kind of junk.

    ``junk``: whether texts may be unreadable, a constant or a column.

    Null, empty and wordless texts get a null language and no stretches; repeated rows stay. Extra columns aren't read.
    """
    shared = df.sparkSession.sparkContext.broadcast(profiles)  # at most 11 languages x TOP n-grams
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", " + LANG_ROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
        for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            texts = [t or "" for t in b.column(0).to_pylist()]
            found = identify(texts, shared.value)
            bad = [junk_kind(t) if k else None for t, k in zip(texts, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[2:], pa.array([f.lang for f in found], pa.string()), pa.array([f.confidence for f in found], pa.float64()), pa.array([f.mixed for f in found], pa.list_(pa.string())), pa.array(bad, pa.string()), pa.array([[dict(zip(("start", "stop", "lang", "confidence"), s)) for s in f.stretches] for f in found], pa.list_(kind))],
                names=[*keep, "lang", "confidence", "mixed", "junk", "stretches"],
            )

    check = F.lit(junk) if isinstance(junk, bool) else junk
    return spread(df.select(F.col(text), check, *keep)).mapInArrow(run, schema)


def label_findings(requests: DataFrame, documents: DataFrame, configs: DataFrame, common_words: DataFrame) -> DataFrame:
    """label_field, rec_id, kind, lang: labels that are missing or wrong, and mixed texts, one row per finding.

    A repeated request (same request_id) gives its findings once. A document without a config has no "config" finding. A text in a
    language without a profile has none: whether its label is right can't be told.
    """
    profiles = train(documents, common_words)
    jobs = configs.select(F.col("job_id"), label_code(F.col("source")).alias("job_lang")).where("job_id is not null and job_lang is not null").groupBy("job_id").agg(F.max("job_lang").alias("job_lang"))
    docs = documents.select("text", F.lit("document").alias("label_field"), F.col("doc_id").cast("string").alias("rec_id"), label_code(F.col("lang")).alias("declared"), "job_id")
    reqs = requests.select("text", F.lit("request").alias("label_field"), F.col("request_id").alias("rec_id"), label_code(F.col("source_language")).alias("declared"), F.lit(None).cast("string").alias("job_id"))
    both = docs.unionByName(reqs)
    got = languages(both, "text", profiles, "label_field", "rec_id", "declared", "job_id", junk=F.col("label_field") == "document").where(F.col("lang").isNotNull() & (F.col("lang") != OTHER) & F.col("junk").isNull()).drop("stretches", "confidence", "junk")
    got = got.withColumn("job_id", spread_nulls("job_id", "rec_id")).join(jobs, "job_id", "left")
    mixed = F.size("mixed") > 1
    none = F.lit(None).cast("string")

    def row(when, field, kind, lang):
        return F.when(when, F.struct(field.alias("label_field"), F.lit(kind).alias("kind"), lang.alias("lang")))

    field, own = F.col("label_field"), F.col("lang")
    found = F.array_compact(
        F.concat(
            F.when(mixed, F.transform("mixed", lambda x: F.struct(field.alias("label_field"), F.lit("mixed").alias("kind"), x.alias("lang")))).otherwise(F.array().cast("array<struct<label_field:string,kind:string,lang:string>>")),
            F.array(
                row(~mixed & F.col("declared").isNull(), field, "missing", own),
                row(~mixed & (F.col("declared") != own), field, "wrong", own),
                row(~mixed & (F.col("job_lang") != own), F.lit("config"), "wrong", own),
            ),
        )
    )
    return got.select("rec_id", F.explode(found).alias("f")).select("f.label_field", "rec_id", "f.kind", "f.lang").distinct()
