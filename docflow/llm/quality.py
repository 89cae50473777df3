"""Text statistics that tell prose from lists, tables and junk (problem 10).

Every statistic is ranked exactly within the document's language and among all documents. The tail probabilities of those that
speak for a kind are combined into outlier scores. A document that lies far enough out for a kind is of that kind if its own
statistics confirm it. Unreadable text is junk whatever its lines look like; between a table and a list the greater score decides.
How far is enough is learnt from labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.constants import constant
from docflow.llm.langs import label_code
from docflow.llm.ranks import weighted_ranks
from docflow.llm.tables import cut, spread

# Statistics of a document, in the order of the columns. Shares lie in 0..1 and are stated in thousandths.
STATS = (
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words", "words_per_line",
    "item_share", "cell_share", "repeat_share", "single_share", "code_share", "broken_share",
)
STEPS = 1000  # steps of a share: with it the number of values that are ranked has a bound
# Statistics whose upper (+1) or lower (-1) tail speaks for a kind. Fixed values.
TAILS = {
    "junk": {"repeat_share": 1, "single_share": 1, "code_share": 1, "broken_share": 1, "symbol_ratio": 1},
    "table": {"cell_share": 1, "punctuated_lines": -1},
    "list": {"item_share": 1, "punctuated_lines": -1},
}
ALL = "*"  # stands for all languages together
QUANTILE, MARGIN = 0.05, 0.5  # of the labelled documents' scores, and the part of it that must be reached
UNLABELLED = 0.35  # score that must be reached where no document of the kind is labelled

WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ'’ऀ-ःऺ-ॏัิ-ฺ็-๎][^\W\d_]*)*")
BULLET = re.compile(r"\s*(?:[•*▪◦·‣●○■□☐☑✓+]|[-–—]|\(?\d{1,3}[.)](?!\d)|\(?[^\W\d_][.)]|\[[ xXvх✓]?\])\s+(?=\S)")
DASH = re.compile(r"\s*[–—]\s+(?=\S)")
SENT_END = re.compile(r"[.!?…。！？।॥][\"'”’»)\]）」』“]*\s*$")
WIDE = re.compile(r"[⺀-鿿豈-﫿ｦ-ﾝ]")
THAI = re.compile(r"[฀-๿]")
# Marks of text read in a wrong encoding: first byte of UTF-8 shown as a letter with its second byte, box drawing for Cyrillic, replacement signs. Fixed values.
AFTER = "\u0080-¿‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€"
BROKEN = re.compile(rf"[ÂÃÄÅÐÑÒÓ][{AFTER}]|[à-ï][{AFTER}]{{2}}|[╨╤╥╙╘р][─-╿]|[─-╿][А-яЁёA-Za-z]|\ufffd|[\x00-\x08\x0e-\x1f]|[РС][Ѐ-Џѐ-џ\u00a0-¿‚-„†-•™€‹›‘’“”–—]")
CODE = re.compile(r"^(?:[0-9a-fA-F]{2}|[0-9a-fA-F]{8,})$")
NAMELIKE = re.compile(r"(?i)https?:|www\.|@|\.(?:pdf|docx?|txt|xml|json|html?|csv|xlsx?|png|jpe?g|zip)\b|_")
MULTI = re.compile(r"\S( {2,}|　+)(?=\S)")
SYMBOL = re.compile(r"[^\w\s]")
LETTERED = re.compile(r"[^\W\d_]\S*")  # from a token's first letter to its end: one for each token with a letter
APART = re.compile(r"[^\W\d_⺀-鿿豈-﫿ｦ-ﾝ฀-๿]")
ALNUM = re.compile(r"[^\W_]")
PLAIN_WORD = re.compile(r"[^\W\d_]+")
INNER = re.compile("[̀-ͯ'’ऀ-ःऺ-ॏัิ-ฺ็-๎]")  # what may stand inside a WORD beside letters
MAYBE_BROKEN = re.compile(r"[ÂÃÄÅÐÑÒÓà-ï╨╤╥╙╘─-╿\ufffd\x00-\x08\x0e-\x1fЀ-Џѐ-џ]|[РС][\u00a0-¿‚-„†-•™€‹›‘’“”–—]")  # what BROKEN needs, but quicker
KANA = re.compile("[぀-ヿｦ-ﾝ]")
DENSE = re.compile(r"[⺀-鿿豈-﫿ｦ-ﾝ฀-๿]")
VOWEL = re.compile("[aeiouyAEIOUY]")
TURN = re.compile(r"(?<=\d)(?=[A-Za-z])|(?<=[A-Za-z])(?=\d)")


def matches(codes: np.ndarray) -> np.ndarray:
    """Exact number of codes equal to the one k places before, for k from 1 to a third of their number (8 at least).

    Few codes are compared shift by shift. Of many, frequent codes are correlated by Fourier transform, and pairs of rare ones counted.
    """
    n = len(codes)
    top = max(8, n // 3)  # what stands there three times
    if n <= 2048:
        return np.array([np.count_nonzero(codes[k:] == codes[:-k]) for k in range(1, top + 1)])
    often = np.bincount(codes) > n**0.5
    size = 1 << (n + top).bit_length()
    power = np.zeros(size // 2 + 1)
    for c in np.flatnonzero(often):
        power += np.abs(np.fft.rfft(codes == c, size)) ** 2
    out = np.rint(np.fft.irfft(power, size)[: top + 1]).astype(np.int64)
    at = np.flatnonzero(~often[codes])
    at = at[np.argsort(codes[at], kind="stable")]
    for j in range(1, len(at)):
        same = codes[at[j:]] == codes[at[:-j]]
        if not same.any():
            break
        far = (at[j:] - at[:-j])[same]
        out += np.bincount(far[far <= top], minlength=top + 1)
    return out[1:]


def repeat_share(codes: np.ndarray) -> float:
    """Greatest share of codes equal to the one k places before, for every k by which three copies fit in (and up to 8)."""
    got = matches(codes)
    return float((got / (len(codes) - np.arange(1, len(got) + 1))).max())


def repeats(tokens: list[str]) -> float:
    """``repeat_share`` of tokens of which at most a third are different ones."""
    n = len(tokens)
    if n < 12 or len(set(tokens)) > 0.34 * n:
        return 0.0
    index: dict[str, int] = {}
    return repeat_share(np.array([index.setdefault(t, len(index)) for t in tokens]))


def char_repeats(text: str) -> float:
    """``repeat_share`` of single characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(c) < 12:
        return 0.0
    return repeat_share(np.unique(c, return_inverse=True)[1])


@lru_cache(1 << 17)
def codelike(token: str) -> bool:
    """Whether a token is encoded data or noise: letters and digits in turns, or a very long run of ASCII. Recent tokens are remembered."""
    t = token.strip(".,;:!?()[]{}\"'«»“”„")
    if len(t) < 2 or not t.isascii():
        return False
    if CODE.match(t):
        return any(c.isdigit() for c in t) or len(t) == 2
    if len(t) > 45 and not NAMELIKE.search(t):
        return True
    if NAMELIKE.search(t):
        return False
    if len(t) >= 8 and t.isalpha() and not VOWEL.search(t):
        return True
    if not t.isalnum() or t.isalpha() or t.isdigit():
        return False
    switches = len(TURN.findall(t))
    return switches >= 2 or (switches >= 1 and len(t) >= 5 and not t[-1].isdigit())


def width(line: str, dense: bool = True) -> float:
    """Length of a line in words of an alphabet: CJK and Thai letters count as parts of a word. ``dense``: whether it may have such."""
    if not dense:
        return float(len(LETTERED.findall(line)))
    wide, thai = len(WIDE.findall(line)), len(THAI.findall(line))
    return wide / 2.2 + thai / 6 + sum(1 for t in line.split() if APART.search(t))


def cells(lines: list[str], ended: list[bool] | None = None, dense: bool = True) -> float:
    """Share of lines that are rows of a table: the same separator with as many cells in most of them."""
    n, most = len(lines), 0.0
    if n < 3:
        return 0.0
    ended = [ends_sentence(x) for x in lines] if ended is None else ended
    for sep in ("|", "\t", ";", ",", "  "):
        if sum(sep in x for x in lines) < max(3, 0.4 * n) and (sep != "  " or sum(sep in x or "　" in x for x in lines) < max(3, 0.4 * n)):
            continue
        counts = [len(MULTI.findall(x)) for x in lines] if sep == "  " else [quoted_out(x).count(sep) for x in lines] if sep in ";," else [x.count(sep) for x in lines]
        with_sep = [c for c in counts if c > 0]
        if len(with_sep) < max(3, 0.4 * n):
            continue
        usual, times = Counter(with_sep).most_common(1)[0]
        if sep in ";," and (usual < 2 and sep == "," or times < 0.85 * len(with_sep)):
            continue
        rows = [i for i, c in enumerate(counts) if (c == usual if sep in ";,|" else c > 0)]
        if sep in "\t  ;,":
            if sum(ended[i] for i in rows) > 0.3 * len(rows):
                continue
            if sep in ";," and sum(lines[i].rstrip().endswith(sep) for i in rows) > 0.5 * len(rows) and usual == 1:
                continue
            room = sum(c + 1 for c in with_sep) if sep in "\t  " else (usual + 1) * len(rows)
            if sum(width(lines[i], dense) for i in rows) > 5.5 * room:
                continue
        most = max(most, len(rows) / n)
    return most


def ends_sentence(line: str) -> bool:
    """Whether a line ends with a sentence's mark, quotes and brackets after it left aside."""
    last = line.rstrip()[-1:]
    return last in ".!?…。！？।॥" if last not in "\"'”’»)]）」』“" else bool(SENT_END.search(line))


def quoted_out(line: str) -> str:
    """A line without what stands in plain quotes, and without decimal commas."""
    return re.sub(r'"[^"]*"', "q", line) if '"' in line else line


def items(lines: list[str], ended: list[bool], dense: bool = True) -> tuple[float, float, float]:
    """Shares of the lines, and of the letters, that are items of a list; words per line."""
    n = len(lines)
    widths = [width(x, dense) for x in lines]
    mean = sum(widths) / max(1, n)
    if n < 3:
        return 0.0, 0.0, mean
    marked = [bool(BULLET.match(x)) for x in lines]
    dashed = [bool(DASH.match(x)) for x in lines]
    if any(dashed):
        spoken = sum(d and (e or bool(THAI.search(x))) and w >= 3 for x, d, e, w in zip(lines, dashed, ended, widths))
        if spoken >= 0.5 * sum(dashed):
            marked = [m and not d for m, d in zip(marked, dashed)]
    short = [w <= 6 and (not e or w <= 4.4) for e, w in zip(ended, widths)]
    if sum(short) < 0.5 * n or n < 5:
        short = [False] * n
    item = [a or b for a, b in zip(marked, short)]
    return sum(item) / n, sum(w for w, i in zip(widths, item) if i) / max(sum(widths), 1e-9), mean


class Vocabulary:
    """Common words by language, for telling a document's language and the share of its common words."""

    def __init__(self, words: dict[str, frozenset[str]]):
        self.of = words
        self.langs: dict[str, list[str]] = {}
        for lang in sorted(words):
            for w in words[lang]:
                self.langs.setdefault(w, []).append(lang)

    def language(self, words: list[str], declared: str | None) -> tuple[str | None, int]:
        """The language with the most common words among ``words``, and their number; of equal ones the declared language."""
        votes: Counter[str] = Counter()
        for w, n in Counter(filter(self.langs.__contains__, words)).items():
            for lang in self.langs[w]:
                votes[lang] += n
        if not votes:
            return declared, 0
        top = max(votes.values())
        best = sorted(x for x, n in votes.items() if n == top)
        return (declared if declared in best else best[0]), top


def doc_stats(text: str, known: Vocabulary, declared: str | None = None) -> tuple[str, list[str], dict[str, float]]:
    """Language, confirmed kinds (see ``confirmed``) and statistics of a text with anything visible."""
    lines = [x for x in text.splitlines() if x.strip()]
    tokens = text.split()
    solid = sum(map(len, tokens))
    words = (WORD if INNER.search(text) else PLAIN_WORD).findall(text.lower())
    letters = sum(map(len, words))
    digits = sum(map(text.count, "0123456789"))
    dense = bool(DENSE.search(text))
    wide, thai = (len(WIDE.findall(text)), len(THAI.findall(text))) if dense else (0, 0)
    single = 0.0
    if wide + thai > 0.5 * letters:  # no blanks between words: the language's common words are looked for as parts
        lang = "th" if thai > wide else "ja" if 8 * len(KANA.findall(text)) >= wide else "zh"
        joined = "".join(words)
        share = sum(joined.count(w) * len(w) for w in known.of.get(lang, ())) / max(1, len(joined))
        n_words = (wide + thai) / 2.2
        rep = char_repeats("".join(tokens)) if len(set(text)) <= 0.34 * solid else 0.0
    else:
        lang, hits = known.language(words, declared)
        share, n_words = hits / len(words) if words else 0.0, float(len(words))
        rep = repeats([t for t in tokens if ALNUM.search(t)]) if len(set(tokens)) <= 0.5 * len(tokens) else 0.0
        parts = text.replace("~", " ").split() if "~" in text else tokens
        single = sum(t[0].isalpha() and t[1:] in ("", ".", ",") for t in parts if len(t) < 3) / max(1, len(parts))
    ended = [ends_sentence(x) for x in lines]
    by_line, by_word, per_line = items(lines, ended, dense)
    broken = len(BROKEN.findall(text)) if MAYBE_BROKEN.search(text) else 0
    solid = max(1, solid)
    rows = cells(lines, ended, dense)
    s = {
        "n_words": n_words,
        "mean_word_length": letters / max(1.0, n_words),
        "symbol_ratio": max(0, solid - letters - digits) / solid,
        "digit_ratio": digits / solid,
        "punctuated_lines": sum(ended) / max(1, len(lines)),
        "common_words": min(1.0, share),
        "words_per_line": per_line,
        "item_share": min(by_line, by_word) * (1 - rows),  # rows of cells are no items
        "cell_share": rows,
        "repeat_share": rep,
        "single_share": single,
        "code_share": sum(len(t) for t in tokens if codelike(t)) / solid,
        "broken_share": min(1.0, 2 * broken / solid),
    }
    return lang or "und", confirmed(s, text), {k: round(v, 3) for k, v in s.items()}


def confirmed(s: dict[str, float], text: str) -> list[str]:
    """The kinds that a text's own statistics bear out, whatever the other documents are."""
    out = ["junk"] if junk_by(s, text) else []
    if s["cell_share"] >= 0.6:
        out.append("table")
    if s["item_share"] >= 0.55:
        out.append("list")
    return out


def junk_by(s: dict[str, float], text: str) -> str | None:
    """What makes a text unreadable, or null."""
    if s["broken_share"] >= 0.008 and len(BROKEN.findall(text)) >= (2 if s["broken_share"] >= 0.02 else 3):
        return "encoding"
    if s["repeat_share"] >= 0.6 and s["cell_share"] < 0.6:
        return "repetition"
    if s["single_share"] >= 0.6 and len(text) >= 30:
        return "spaced"
    if s["code_share"] >= 0.5 and len(text) >= 30:
        return "data"
    if (s["symbol_ratio"] >= 0.75 and s["cell_share"] < 0.9 or s["symbol_ratio"] >= 0.55 and s["cell_share"] < 0.6) and len(text) >= 30 and s["item_share"] < 0.5:
        return "noise"
    return None


def junk_kind(text: str) -> str | None:
    """What makes a text unreadable, or null, as ``junk_by`` says; texts shorter than 30 characters never are.

    Statistics are computed only as far as they are needed: one that can't reach its bound is left at 0.
    """
    if len(text) < 30:
        return None
    broken = len(BROKEN.findall(text)) if BROKEN.search(text) else 0
    tokens = text.split()
    solid = sum(map(len, tokens)) or 1
    wide = len(WIDE.findall(text)) + len(THAI.findall(text)) > 0.5 * solid
    s = {"broken_share": 2 * broken / solid, "repeat_share": 0.0, "single_share": 0.0, "code_share": 0.0, "symbol_ratio": 0.0, "cell_share": 0.0, "item_share": 0.0}
    if wide:
        if len(set(text)) <= 0.34 * solid:
            s["repeat_share"] = char_repeats("".join(tokens))
    else:
        if len(set(tokens)) <= 0.5 * len(tokens):
            s["repeat_share"] = repeats([t for t in tokens if any(map(str.isalnum, t))])
        if solid < 4 * len(tokens):  # else most tokens can't be single letters
            parts = text.replace("~", " ").split()
            s["single_share"] = sum(len(t) <= 2 and t[0].isalpha() and t[1:] in ("", ".", ",") for t in parts) / max(1, len(parts))
        plain = len(text.encode("ascii", "ignore"))
        if plain >= 0.5 * len(text):
            digits, vowels = sum(map(text.count, "0123456789")), sum(map(text.count, "aeiouAEIOU"))
            if digits >= 0.05 * solid or vowels < 0.2 * plain or max(map(len, tokens), default=0) > 45:
                s["code_share"] = sum(len(t) for t in tokens if codelike(t)) / solid
    if len(SYMBOL.findall(text)) >= 0.5 * solid:
        full = doc_stats(text, Vocabulary({}))[2]
        s |= {k: full[k] for k in ("symbol_ratio", "cell_share", "item_share")}
    elif s["repeat_share"] >= 0.6:
        s["cell_share"] = cells([x for x in text.splitlines() if x.strip()])
    return junk_by(s, text)


def statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, lang, confirmed and the STATS of every document with anything visible.

    The language is the one whose common words are the most in the text; a text without any takes the declared one, else "und".
    Null and blank texts give no row; repeated rows and ids stay.
    """
    words: dict[str, set[str]] = {}
    for r in common_words.select("lang", "word").where("lang is not null and word is not null").collect():  # a fixed table
        words.setdefault(r.lang, set()).add(r.word.lower())
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary({k: frozenset(v) for k, v in words.items()}))
    names = ["doc_id", "lang", "confirmed", *STATS]
    schema = "doc_id bigint, lang string, confirmed array<string>, " + ", ".join(f"{s} double" for s in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            memo: dict[tuple[str, str | None], tuple] = {}
            rows = []
            for key in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if key not in memo:
                    lang, kinds_, s = doc_stats(key[0], known, key[1])
                    memo[key] = (lang, kinds_, *s.values())
                rows.append(memo[key])
            cols = list(zip(*rows)) if rows else [()] * (2 + len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.string())), *(pa.array(c, pa.float64()) for c in cols[2:])], names=names)

    visible = F.length(F.regexp_replace("text", r"(?U)[\s\p{Cf}]+", "")) > 0
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", label_code(F.col("lang")).alias("declared")).where(F.col("text").isNotNull() & visible)
    return spread(rows).mapInArrow(run, schema)


def tails(stats: DataFrame) -> DataFrame:
    """lang, stat, step, up, down: tail probabilities of every value of the statistics that speak for a kind.

    Distinct values are counted by language, and for ALL documents together, sorted by range over all partitions, and the partitions'
    counts give their offsets: the ranks are exact. up is the share of documents at or above a value, down of those at or below it.
    """
    used = sorted({s for t in TAILS.values() for s in t})
    one = F.array(*[F.struct(F.lit(s).alias("stat"), F.round(F.col(s) * STEPS).cast("int").alias("step")) for s in used])
    per = stats.select("lang", F.explode(one).alias("x")).groupBy("lang", "x.stat", "x.step").agg(F.count("*").alias("n"))
    per = per.unionByName(per.groupBy("stat", "step").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(ALL)))
    ranked = weighted_ranks(per, ["lang", "stat"], "step", "n")
    return ranked.select("lang", "stat", "step", (1 - F.col("below") / F.col("total")).alias("up"), ((F.col("below") + F.col("n")) / F.col("total")).alias("down"))


def outlier_scores(stats: DataFrame) -> DataFrame:
    """``stats`` with junk_score, table_score and list_score: sums of -ln of the tail probabilities that speak for the kind.

    Of a value's tails in its language and among all documents the smaller one counts, so that in a language made mostly of one
    kind, or of few documents, a document still lies as far out as it does among all. The tails are at most STEPS + 1 for a
    language and statistic, so one small row for each language is joined and no document is shuffled.
    """
    used = sorted({(s, d) for t in TAILS.values() for s, d in t.items()})
    table: dict[str, dict[tuple[str, int], list[float]]] = {}
    for r in tails(stats).collect():  # at most languages x statistics x (STEPS + 1) rows
        for s, d in used:
            if s == r.stat:
                table.setdefault(r.lang, {}).setdefault((s, d), [0.0] * (STEPS + 1))[r.step] = -math.log(r.up if d > 0 else r.down)
    name = lambda s, d: f"{s}_{'up' if d > 0 else 'down'}"
    ddl = "lang string, " + ", ".join(f"{name(*x)} array<double>" for x in used)
    known = constant(stats.sparkSession, [(lang, *(t[x] for x in used)) for lang, t in table.items()], ddl)
    both = stats.withColumn("__every", F.lit(ALL))
    for side, key in (("own", "lang"), ("all", "__every")):
        part = known.select(F.col("lang").alias(f"__{side}_lang"), F.struct(*[name(*x) for x in used]).alias(f"__{side}"))
        both = both.join(F.broadcast(part), F.col(key) == F.col(f"__{side}_lang"), "left")
    scores = []
    for kind, of in TAILS.items():
        total = F.lit(0.0)
        for s, d in of.items():
            at = F.round(F.col(s) * STEPS).cast("int")
            total = total + F.greatest(F.get(F.col("__own")[name(s, d)], at), F.get(F.col("__all")[name(s, d)], at))
        scores.append(F.round(total, 6).alias(f"{kind}_score"))
    return both.select(*stats.columns, *scores)


def reach(scored: DataFrame, labels: DataFrame) -> dict[str, float]:
    """The score that each kind must reach, from the labelled documents of the kind (few by their nature: a hand-made sample)."""
    own = labels.where("doc_id is not null and kind is not null").select("doc_id", F.col("kind").alias("__kind"))
    picks = [F.percentile(F.when(F.col("__kind") == k, F.col(f"{k}_score")), QUANTILE).alias(k) for k in TAILS]
    row = scored.select("doc_id", *[f"{k}_score" for k in TAILS]).join(own, "doc_id").agg(*picks).first()
    return {k: UNLABELLED if row[k] is None else MARGIN * row[k] for k in TAILS}


def kinds(documents: DataFrame, common_words: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, kind (prose, list, table, junk), the statistics and the outlier scores of every visible document.

    A document is of a kind if its score reaches what the kind must reach and its own statistics confirm the kind; junk goes before
    the others, and of table and list the one counts for which the document lies farther out. All other documents are prose.
    Repeated rows give repeated results; their copies count in the ranks.
    """
    scored = cut(outlier_scores(cut(statistics(documents, common_words))))
    least = reach(scored, labels)
    far = [F.when(F.array_contains("confirmed", k) & (F.col(f"{k}_score") >= x), F.struct(F.lit(k == "junk").alias("unreadable"), (F.col(f"{k}_score") / max(x, 1e-9)).alias("far"), F.lit(k).alias("kind"))) for k, x in least.items()]
    top = F.array_max(F.array_compact(F.array(*far)))
    return scored.withColumn("kind", F.coalesce(top["kind"], F.lit("prose"))).drop("confirmed")
