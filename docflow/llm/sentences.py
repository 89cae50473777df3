"""Sentence boundaries in all languages and scripts present (problem 5).

A text is cut at line breaks. In each line every mark that may end a sentence, and every blank beside a Thai letter,
is a candidate boundary. A semi-Markov dynamic program then picks the best sequence of whole spans between candidates:
a span's score joins its closing word and mark, the opening word after it, its length, and the balance of its quotations.
Null, empty and blank texts have no sentence. Repeated rows each give their own sentences.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.lookalikes import transducer
from docflow.llm.tables import spread

# Abbreviations that stand before the rest of their sentence. Fixed values.
BEFORE = (
    "dr mr mrs ms prof st no nos nr fig figs sec secs vol vols ch chap p pp approx vs cf e.g i.e eg ie al ed eds rev gen col inc ltd jan feb mar apr jun jul aug sep sept oct nov dec"
    " bd bde abb abs abschn kap s z.b d.h u.a v.a vgl ca bzw ggf inkl evtl hr fr sog str tel mind max min z d"
    " m mm mme mlle env av art ex p.ex réf n° cap capít pág págs pag sr sra srta ee d.ª núm n.º aprox p.ej ej véase tbm seç tab exmo ref n.o nº"
    " см рис разд стр гл т.е т.к т.н напр прибл им ул г д-р проф акад тов стр пп п № див розд мал стор напр пр приб вул тобто ім"
    " डॉ श्री श्रीमती प्रो क्र सं"
)
# Abbreviations that mostly close a list, so that a sentence may end with them. Fixed values.
LAST = {"etc", "usw", "т.д", "т.п", "др", "пр", "ff", "т.д", "и.т.д", "і.т.д", "тощо", "u.s.w", "i.n.f"}
# Units and names with periods that end a sentence only if a new one plainly begins. Fixed values.
UNITS = {"a.m", "p.m", "u.s", "u.k", "u.n", "ee.uu", "ч", "h", "м", "км", "кг", "мин", "сек", "руб", "тыс", "млн", "год", "хв", "грн", "min", "hrs", "inc", "co", "corp", "jr", "ltd", "uhr", "m", "d.c", "g"}
# Months: a number with a period before them is a date. Fixed values.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner jan feb mär apr jun jul aug sept okt nov dez".split())
# Endings of file names and hosts, after which no space is missing. Fixed values.
FILE_ENDS = "pdf docx doc txt xml json html htm csv tsv xlsx xls pptx ppt png jpg jpeg gif svg zip gz tar xz md log ini cfg yml yaml exe dll py js css db sqlite odt rtf epub com org net io".split()
# Words of scripts without letter case that continue a clause after a pause. Fixed values.
GO_ON = ("正在", "约", "約", "的", "和", "と", "って", "という", "は", "が", "を", "に")

SHY = "­​‌‍⁠﻿"
CLOSE = "\"'”’»)\\]）」』〉》】›’"
LINE = re.compile(r"[^\n\r  \x0b\x0c\x85]+")
CAND = re.compile(
    rf"(?P<m>(?:\s\.\.\.+|[.!?…。！？｡।॥]+)[{SHY}]*(?:\s?»|[{CLOSE}{SHY}])*(?:[.!?…。！？]+(?:\s?»|[{CLOSE}{SHY}])*)?)(?P<w>\s*)|(?<=[฀-๿])(?P<t>\s+)(?=\S)|(?<=\S)(?P<u>\s+)(?=[฀-๿])"
)
MARK = re.compile(r"[.!?…。！？｡।॥]")
FAST = re.compile(r"[.!?…。！？｡।॥฀-๿]")
MASK = re.compile(
    r"(?i)(?:https?://|www\.|mailto:)[^\s<>\"“”«»（）。！？　-ヿ一-鿿]+|(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<![\w-])[\w-]+(?:\.[\w-]+)*\.(?:" + "|".join(FILE_ENDS) + r")(?![A-Za-z])"
)
BREAKS = frozenset("(（[«“„\"'「『—–¿¡")  # beside white space, what a token doesn't hold
FIRST_WORD = re.compile(r"\w+")
SOLID = re.compile(r"\s*(\S)")
TAIL2 = re.compile(r"(\S{1,4}\.)\s$")
QUOTES = re.compile("[«»“”„「」『』\"]")
OPENERS = "«“„「『¿¡([（\"‘—–•*"


STRIP = dict.fromkeys(map(ord, SHY))


def letter_table() -> dict[int, str]:
    """Letters and digits that only look different, each to one plain character; quotation marks and blanks stay."""
    table = transducer().table
    return {c: v[0] for c, v in table.items() if v and unicodedata.category(chr(c))[0] in "LN" and v[0].isalnum()}


def in_plain_letters(words: set[str]) -> frozenset[str]:
    table = letter_table()
    return frozenset(x.translate(table).lower() for w in words for x in (w, w.upper(), w.capitalize(), w.replace("fi", "ﬁ"), w.replace("fl", "ﬂ")))


@lru_cache(1)
def plain_letters() -> tuple[dict[int, str], re.Pattern]:
    return letter_table(), re.compile(f"[{SHY}]")


@lru_cache(1)
def known_words() -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Abbreviations before the rest of a sentence, at its end, and units."""
    return in_plain_letters(set(BEFORE.split()) - UNITS - LAST), in_plain_letters(LAST), in_plain_letters(UNITS)


def quotation(line: str) -> dict[int, int]:
    """Opening position of each closing quotation mark whose partner is in the line."""
    pairs: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in QUOTES.finditer(line):
        q, at = m.group(), m.start()
        if q in "«„「『" or (q == "“" and not any(x == "„" for x, _ in stack)) or (q == '"' and not any(x == '"' for x, _ in stack)):
            stack.append((q, at))
            continue
        fits = {"»": "«", "”": "“„", "“": "„", "」": "「", "』": "『", '"': '"'}[q]
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in fits:
                pairs[at] = stack[k][1]
                del stack[k:]
                break
    return pairs


@lru_cache(1)
def longest_known() -> int:
    """Characters of the longest word that ``closing`` knows: a longer one needn't be read to its beginning."""
    return max(map(len, frozenset().union(*known_words())), default=0) + 1


def last_word(line: str, end: int) -> tuple[int, bool]:
    """Where the token that ends at ``end`` begins, and whether it is known to be longer than any word that ``closing`` knows."""
    at, longest = end, longest_known()
    while at > 0 and line[at - 1] not in BREAKS and not line[at - 1].isspace():
        at -= 1
        if end - at > longest and not line[at].isdigit():
            return at, True
    return at, False


def closing(line: str, end: int, mark: str) -> tuple[float, str]:
    """Score of the mark after ``end`` as a sentence's end by the word before it, and the word's class."""
    if mark[:1].isspace():
        return -6.0, "pause"
    first = mark[0]
    if first != "." or mark.startswith(".."):
        return (1.2 if mark.startswith("……") else 2.5 if first in "…." else 3.0), "pause" if first in "…." else "strong"
    before_set, last_set, unit_set = known_words()
    begin, long = last_word(line, end)
    word = line[begin:end]
    low = word.lower() if word.isascii() else unicodedata.normalize("NFC", word.lower())
    if len(word) == 1 and word.isupper():
        return -5.0, "letter"
    if not long:
        two = TAIL2.search(line[max(0, begin - 6) : begin]) if word else None  # "z." of "z. B."
        joined = (two.group(1) + low).lower() if two else low
        if joined in last_set or low in last_set:
            return 0.6, "last"
        if joined in unit_set or low in unit_set:
            return -0.8, "unit"
        if joined in before_set or low in before_set:
            return -6.0, "abbr"
        if len(low) == 1 and low.isalpha() and not "　" < low < "ﬀ":
            return -5.0, "letter"
    if low.endswith(("-р", "-p")):
        return -6.0, "abbr"
    if "'" in low and low.rpartition("'")[2] in before_set:
        return -6.0, "abbr"
    if "’" in low and low.rpartition("’")[2] in before_set:
        return -6.0, "abbr"
    if low.isdigit():
        return 2.0, "number" if line[:begin].strip() else "item"
    return 3.0, "word"


def opening(line: str, at: int, kind: str, glued: bool, mark: str, capitals: bool) -> float:
    """Score of the word at ``at`` as a sentence's first, after a word of class ``kind`` and its mark."""
    c = line[at]
    if kind == "item":
        return -9.0
    if c in ",;:，；：、)）]»”":
        return -9.0
    if c in "—–-" and ((m := SOLID.match(line, at + 1)) and m.group(1).islower() or capitals and mark[-1:] in "»”“\"」"):
        return -9.0
    if c.isupper() or c in OPENERS:
        if kind == "number" and (m := FIRST_WORD.match(line, at)) and m.group().lower() in MONTHS:
            return -9.0
        if capitals and c.isupper():
            return 0.0
        return 2.0 if kind == "unit" else 1.0
    if c.islower():
        if glued and kind == "number":
            return -6.0
        return -1.5 if kind == "unit" else 0.0
    if c.isdigit():
        return -6.0 if glued and kind in ("number", "letter") else 0.0
    if line.startswith(GO_ON, at):
        return -9.0 if mark[-1:] in "」』”»" or kind == "pause" else 0.0
    return 0.5


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points, edges without white space."""
    if text.isascii():
        return plain_spans(text)
    table, invisible = plain_letters()
    plain = text.translate(table)
    if not invisible.search(plain):
        return plain_spans(plain)
    kept = [i for i, c in enumerate(plain) if c not in SHY]
    out = []
    for a, b in plain_spans(plain.translate(STRIP)):
        e = kept[b - 1] + 1
        while e < len(text) and text[e] in SHY:  # an invisible character belongs to the mark before it
            e += 1
        out.append((kept[a], e))
    return out


def plain_spans(text: str) -> list[tuple[int, int]]:
    """``spans`` of a text in plain letters without invisible characters."""
    out: list[tuple[int, int]] = []
    if not FAST.search(text):
        for m in LINE.finditer(text):
            trimmed(text, m.start(), m.end(), out)
        return out
    for m in LINE.finditer(text):
        s, e = m.span()
        line = m.group()
        cuts = boundaries(line)
        at = 0
        for c in cuts:
            trimmed(text, s + at, s + c, out)
            at = c
        trimmed(text, s + at, e, out)
    return out


def trimmed(text: str, s: int, e: int, out: list[tuple[int, int]]) -> None:
    while s < e and text[s].isspace():
        s += 1
    while e > s and text[e - 1].isspace():
        e -= 1
    if s < e:
        out.append((s, e))


@dataclass
class Boundary:
    """A place where a sentence may end and the next begin."""

    end: int  # after the closing mark
    begin: int  # where the next span begins
    closes: float  # score of the closing word and mark for the span before
    opens: float  # score of the opening word for the span after
    speaker: bool  # whether what follows may name who spoke before


def may_speak(line: str, at: int, capitals: bool) -> bool:
    """Whether the words at ``at`` may go on after a quotation, as in "…" he said."""
    c = line[at]
    return not ((c.isupper() and not capitals) or c.isdigit() or c in OPENERS)


def candidates(line: str, quotes: dict[int, int]) -> list[Boundary]:
    """The boundaries of a line that its marks allow, in order; addresses and file names have none inside."""
    found = list(CAND.finditer(line))
    full = len(line)
    if not found or (len(found) == 1 and found[0].end() == full):
        return []
    masked = [x.span() for x in MASK.finditer(line)] if ("." in line or "?" in line) else []
    capitals = line == line.upper() and line != line.lower()
    out, k = [], 0
    for m in found:
        if m.group("m") is None:
            at, w = m.start(), m.end()
            c, mark, kind, glued = 2.0, "", "thai", False
        else:
            s, at = m.span("m")
            w = m.end()
            if at < full and line[at] == "“" and at in quotes:  # closes „
                at += 1
                while at < full and line[at] in ".!?":
                    at += 1
                w = at
                while w < full and line[w].isspace():
                    w += 1
            while k < len(masked) and masked[k][1] <= s:
                k += 1
            if k < len(masked) and masked[k][0] <= s < masked[k][1]:
                if not (masked[k][1] <= at and w > at):
                    continue
            mark = m.group("m")
            if mark[0] == "." and at - s == 1 and w == at and line[s - 1 : s].isdigit() and line[at : at + 1].isdigit():
                continue
            glued = w == at
            c, kind = closing(line, s, mark)
        if w >= full:
            break
        out.append(Boundary(at, w, c, opening(line, w, kind, glued, mark, capitals), bool(quotes) and may_speak(line, w, capitals)))
    return out


USUAL = math.log(60)  # logarithm of a sentence's usual length in characters
LENGTH_WEIGHT = 0.03
UNBALANCED = 7.0  # cost of a span that has one mark of a quotation without the other, or lies inside one
SPOKEN = 7.0  # cost of a span that ends with a sentence wholly quoted although its speaker follows


def length_score(n: int) -> float:
    """Score of a span's length: the farther from the usual one in proportion, the worse; a span of one or two characters is hardly one."""
    return -LENGTH_WEIGHT * (math.log(n) - USUAL) ** 2 - (1.0 if n < 3 else 0.0)


def quoted_at(quotes: dict[int, int], places: list[int]) -> list[int]:
    """How many quotations are open at each of the places, which are in order."""
    opened, closed = sorted(quotes.values()), sorted(quotes)
    return [bisect.bisect_left(opened, x) - bisect.bisect_left(closed, x) for x in places]


def boundaries(line: str) -> list[int]:
    """Inner cuts of a line by a semi-Markov dynamic program over whole spans.

    A span between two boundaries scores its opening word, its closing word and mark, its length, whether its quotations are
    balanced, and whether it ends with a quoted sentence whose speaker follows. The cuts of the greatest sum win.

    A cut adds at most what the longest possible span could lose by its length, so a boundary that costs more is in no best
    sequence and is left out before: the program stays linear where thousands of abbreviations, or quoted sentences, follow each other.
    """
    quotes = quotation(line) if QUOTES.search(line) else {}
    inner = candidates(line, quotes)
    if not inner:
        return []
    full = len(line)
    gain = -length_score(full)
    held = quoted_at(quotes, [x.begin for x in inner]) if quotes else [0] * len(inner)
    inner = [x for x, q in zip(inner, held) if x.closes + x.opens + gain > (UNBALANCED if q else 0.0)]
    if not inner:
        return []
    marks = [Boundary(0, 0, 0.0, 0.0, False), *inner, Boundary(full, full, 0.0, 0.0, False)]
    n = len(marks)
    inside = quoted_at(quotes, [x.begin for x in marks]) if quotes else [0] * n
    # a quotation that ends with a boundary's mark, whose speaker may follow, and that begins where a sentence may: its place
    spoken = [-1] * n
    if quotes:
        starts = {x.begin for x in marks}
        starts.add(len(line) - len(line.lstrip()))
        for j, x in enumerate(inner, 1):
            if x.speaker and (at := next((quotes[p] for p in range(x.end - 1, max(x.end - 4, -1), -1) if p in quotes), -1)) in starts:
                spoken[j] = at
    best, prev, most = [0.0] * n, [0] * n, [0.0] * n
    for j in range(1, n):
        top, arg = -math.inf, 0
        gain = marks[j].closes
        for i in range(j - 1, -1, -1):
            if most[i] + gain <= top:  # nothing before can do better
                break
            begin = marks[i].begin
            v = best[i] + marks[i].opens + gain + length_score(max(1, marks[j].end - begin))
            if inside[i] or inside[j]:
                v -= UNBALANCED
            if spoken[j] >= begin:
                v -= SPOKEN
            if v > top:
                top, arg = v, i
        best[j], prev[j] = top, arg
        most[j] = max(most[j - 1], top + marks[j].opens)
    cuts, j = [], prev[n - 1]
    while j > 0:
        cuts.append(marks[j].begin)
        j = prev[j]
    return cuts[::-1]


def sentence_ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and end of every sentence of a batch; equal texts are cut once."""
    codes = texts.dictionary_encode()
    known = [np.array([e for _, e in spans(t)], dtype=np.int32) for t in codes.dictionary.to_pylist()]
    ids = codes.indices.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(~np.isnan(ids)) if ids.dtype.kind == "f" else np.arange(len(ids))
    per = [known[int(ids[r])] for r in rows]
    return np.repeat(rows, [len(x) for x in per]), np.concatenate(per) if per else np.zeros(0, np.int32)


def sentences(df: DataFrame, table: str, id_column: str, text_column: str = "text") -> DataFrame:
    """rec_table, rec_id, end_pos of each sentence of each row of ``df``; other columns of ``df`` don't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ends = sentence_ends(b.column(1))
            ids = b.column(0).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(ends, pa.int32())], names=["rec_id", "end_pos"])

    part = df.select(F.col(id_column).cast("bigint").alias("rec_id"), F.col(text_column).alias("text")).where("text is not null")
    return spread(part).mapInArrow(run, "rec_id bigint, end_pos int").select(F.lit(table).alias("rec_table"), "rec_id", "end_pos")
