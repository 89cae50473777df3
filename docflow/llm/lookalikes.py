"""One consistent form for texts that look the same (problem 7).

A transducer compiled once maps every character, and every grapheme cluster with a mapping of its own, to its form of equal
look: widths, presentation forms, joined letters, blanks, hyphens and invisible characters, then letters of other scripts
that can't be told apart by eye. It reads a text once, longest match first. Mappings that would make another mapping's result
map again are resolved, and two results for one cluster are refused, when it is compiled.

Texts of one look are a class. Exactly equal texts are one spelling of it; work and output grow with the rows and, only where
pairs are asked for, with the pairs of rows of different spellings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.tables import cut, small, spread

# Letters that look like Latin ones, by script. Fixed values.
TWINS = {
    "cyrillic": ("АВЕЅІЈКМНОРСТХУҮаеіјорсухѕһԁԛԝӏҺԌԚԜ", "ABESIJKMHOPCTXYYaeijopcyxshdqwlhGQW"),
    "greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"),
    "armenian": ("ՏՕօոսցհ", "SOonugh"),
    "other": ("ıȷɑɡℓ", "ijagl"),
}
# Signs that look alike. Fixed values.
SIGNS = {
    "‐‑‒–−﹣－⁃": "-", "―": "—", "‘’ʼ＇ʹ′ˈ": "'", "“”″": '"', "·∙⋅•‧・ꞏ": "·", "∶꞉": ":", "∕⁄": "/", "∗": "*", "∣ǀ": "|",
    "µ": "μ", "Ω": "Ω", "∑": "Σ", "∏": "Π", "∆": "Δ", "ǃ": "!", "；;": ";", "‚": ",", "〈": "⟨", "〉": "⟩",
}
INVISIBLE = "­͏؜ᅟᅠ឴឵​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
#: Code points that may decompose, combine or be invisible: the planes above hold none.
ASSIGNED = (*range(0x32400), *range(0xE0000, 0xE0200))
#: Compatibility forms that look different from their plain ones. Fixed values.
DIFFERENT = frozenset(("<super>", "<sub>", "<circle>", "<fraction>", "<square>"))


def equal_look(ch: str) -> str | None:
    """Form of equal look of one character by its compatibility decomposition, or None if the look differs or nothing changes."""
    d = unicodedata.decomposition(ch)
    tag = d.split(" ", 1)[0] if d.startswith("<") else ""
    if tag in DIFFERENT or (tag == "<compat>" and ch in "…‥⁇⁈⁉‼№℡™℠´¨¯¸˘˙˚˛˜˝ͺ΄₨℀℁℅℆"):
        return None
    if tag == "<compat>" and unicodedata.category(ch) in ("No", "Nl", "So"):
        name = unicodedata.name(ch, "")
        return unicodedata.normalize("NFKC", ch) if "RADICAL" in name or "ROMAN" in name else None
    form = unicodedata.normalize("NFKC", ch) if d else ch
    return form if form != ch else None


def char_class(chars: set[int]) -> str:
    """Ranges of code points for a character class."""
    out, run = [], []
    for c in sorted(chars):
        if run and c == run[-1] + 1:
            run[1:] = [c]
            continue
        if run:
            out.append(run)
        run = [c]
    out += [run] if run else []
    return "".join(re.escape(chr(r[0])) + (f"-{re.escape(chr(r[-1]))}" if len(r) > 1 else "") for r in out)


class Transducer:
    """Table of clusters to forms, and the pattern that finds clusters with a form of their own."""

    def __init__(self) -> None:
        signs = {c: v for k, v in SIGNS.items() for c in k if c != v}
        twins = {c: v for froms, tos in TWINS.values() for c, v in zip(froms, tos, strict=True)}
        both = set(signs) & set(twins)
        if both:
            raise ValueError(f"two forms for {both}")
        base: dict[int, str] = {}
        for cp in ASSIGNED:
            if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
                continue
            c = chr(cp)
            if c in signs or c in twins:
                base[cp] = signs.get(c) or twins[c]
            elif c in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
                base[cp] = ""
            elif unicodedata.category(c) == "Zs" or c == "\t":
                base[cp] = " "
            elif (v := equal_look(c)) is not None:
                base[cp] = v
        self.base = base
        for _ in range(4):  # a form's own characters get their forms
            base.update({k: v.translate(base) for k, v in base.items()})
        # precomposed letters over a letter with a form, such as ï of і and its dots
        self.forms: dict[str, str] = {}
        for cp in ASSIGNED:
            if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
                continue
            c = chr(cp)
            if cp in base or unicodedata.decomposition(c):
                v = self.derive(c)
                if v != c:
                    self.forms[c] = v
        for c, v in self.forms.items():
            if self.derive(v) != v:
                raise ValueError(f"the form of U+{ord(c):04X} has another form")
        self.table = {ord(c): v for c, v in self.forms.items()}
        self.precompute()
        # what continues a cluster: marks, whatever composes with a letter before it, half-width voicing, invisible characters
        more = {0xFF9E, 0xFF9F, *range(0x1160, 0x1200), *range(0xFE00, 0xFE10), *map(ord, INVISIBLE)}
        for cp in ASSIGNED:
            if cp >= 0x300 and not 0xD800 <= cp < 0xE000 and not 0xAC00 <= cp < 0xD7A4:
                if unicodedata.combining(chr(cp)):
                    more.add(cp)
                d = unicodedata.decomposition(chr(cp))
                if d and not d.startswith("<") and " " in d:
                    more.update(int(x, 16) for x in d.split()[1:])
        follow = f"[{char_class(more)}]"
        self.marked = re.compile(follow)
        self.cluster = re.compile(f"[^\n\r]{follow}+")

    def precompute(self) -> None:
        """The forms of all clusters of a letter and its marks that have a composed letter, in every degree of composition."""
        for cp in ASSIGNED:
            if cp < 0xC0 or 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
                continue
            d = unicodedata.decomposition(chr(cp))
            if not d or d.startswith("<"):
                continue
            whole = unicodedata.normalize("NFD", chr(cp))
            form = self.derive(chr(cp))
            for k in range(1, len(whole)):
                c = unicodedata.normalize("NFC", whole[:k]) + whole[k:]
                if self.forms.setdefault(c, form) != form:
                    raise ValueError(f"two forms for the parts of U+{cp:04X}")

    def derive(self, cluster: str) -> str:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", cluster).translate(self.base))

    def form(self, cluster: str) -> str:
        """The form of a cluster: precomputed, or put together from its parts by the same rules and kept."""
        v = self.forms.get(cluster)
        if v is None:
            v = self.derive(cluster)
            if len(self.forms) < 200_000:
                self.forms[cluster] = v
        return v

    def read(self, text: str) -> str:
        """The text's form, read once: clusters where there are any, single characters between them."""
        out, at = [], 0
        for m in self.cluster.finditer(text):
            if m.start() > at:
                out.append(text[at : m.start()].translate(self.table))
            out.append(self.form(m.group()))
            at = m.end()
        out.append(text[at:].translate(self.table))
        return "".join(out)


@lru_cache(1)
def transducer() -> Transducer:
    """Compiled once by each Python worker."""
    return Transducer()


def canonical(text: str) -> str:
    """The text's consistent form. Case, accents of one side only, ё and ß, and raised, lowered or circled digits stay."""
    if text.isascii():
        return text.replace("\t", " ") if "\t" in text else text
    t = transducer()
    return t.read(text) if t.marked.search(text) else text.translate(t.table)


def canonical_column(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``canon`` of every row; a null text has a null form. Equal texts of a batch are read once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", canon string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(0).dictionary_encode()
            forms = pa.array([canonical(t) for t in codes.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], forms.take(codes.indices)], names=[*keep, "canon"])

    return spread(df.select(text, *keep)).mapInArrow(run, schema)


def hashed(df: DataFrame, id_column: str, text: str, groups: list[str]) -> DataFrame:
    """id, the groups, and 96 bits of hashes each for the form (c64, c32) and the spelling (r64, r32) of every row with a text.

    A text of plain ASCII is its own form and stays in the JVM. Rows without a group are no one's likeness and left out.
    """
    src = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("raw"), *groups).where(F.col("raw").isNotNull())
    for g in groups:
        src = src.where(F.col(g).isNotNull())
    plain = F.col("raw").rlike(r"^[\x00-\x08\x0a-\x7f]*$")
    hashes = lambda c, k: (F.xxhash64(c).alias(f"{k}64"), F.hash(c).alias(f"{k}32"))
    odd = canonical_column(src.where(~plain), "raw", "id", "raw", *groups)
    odd = odd.select("id", *groups, *hashes("canon", "c"), *hashes("raw", "r"))
    own = src.where(plain).select("id", *groups, *hashes("raw", "c"), *hashes("raw", "r"))
    return own.unionByName(odd)


def several(df: DataFrame, id_column: str, text: str, groups: list[str]) -> DataFrame:
    """The rows of ``hashed`` whose class has several spellings: its least isn't its greatest, by extremes taken before the shuffle."""
    key = [*groups, "c64", "c32"]
    rows = cut(hashed(df, id_column, text, groups))
    spelling = F.struct("r64", "r32")
    wanted = rows.groupBy(*key).agg(F.min(spelling).alias("lo"), F.max(spelling).alias("hi")).where("lo <> hi").select(*key)
    return cut(rows.join(small(cut(wanted)), key, "left_semi"))


def spelled(rows: DataFrame, groups: list[str]) -> DataFrame:
    """The spellings of every class that has several: groups, c64, c32, r64, r32, n (rows), in_class (rows of the class).

    Copies are counted before the shuffle, so a text that a third of all rows share is one row from here on.
    """
    key = [*groups, "c64", "c32"]
    each = rows.groupBy(*key, "r64", "r32").agg(F.count("*").alias("n"))
    classes = each.groupBy(*key).agg(F.count("*").alias("spellings"), F.sum("n").alias("in_class")).where("spellings > 1").drop("spellings")
    return each.join(classes, key)


def look_classes(df: DataFrame, table: str, id_column: str, text: str, groups: list[str]) -> DataFrame:
    """rec_table, id, class_id, links of every row whose look another spelling shares: links is the number of rows that look
    the same and are spelled otherwise. Null texts and null groups have none. The work is linear in the rows.
    """
    key = [*groups, "c64", "c32", "r64", "r32"]
    rows = several(df, id_column, text, groups)
    some = spelled(rows, groups).select(*key, (F.col("in_class") - F.col("n")).alias("links"))
    class_id = F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in [*groups, "c64", "c32"]]))
    return rows.join(some, key).select(F.lit(table).alias("rec_table"), "id", class_id.alias("class_id"), "links")


def same_look(df: DataFrame, table: str, id_column: str, text: str, groups: list[str]) -> DataFrame:
    """rec_table, id_a, id_b: pairs of rows of a group whose texts differ in characters but not in look.

    Null texts and null groups give no pair; exactly equal texts are none either. Pairs of spellings are formed first and each
    is filled with its rows, so that nothing is joined that is not in the result; for a class of many rows see ``look_classes``.
    """
    key = [*groups, "c64", "c32"]
    rows = several(df, id_column, text, groups)
    some = cut(spelled(rows, groups).select(*key, "r64", "r32"))
    a = some.withColumnsRenamed({"r64": "a64", "r32": "a32"})
    b = some.withColumnsRenamed({"r64": "b64", "r32": "b32"})
    both = a.join(b, key).where("a64 < b64 or (a64 = b64 and a32 < b32)")
    ids = rows.join(some, [*key, "r64", "r32"], "left_semi")
    left = ids.withColumnsRenamed({"r64": "a64", "r32": "a32", "id": "x"})
    right = ids.withColumnsRenamed({"r64": "b64", "r32": "b32", "id": "y"})
    pairs = both.join(left, [*key, "a64", "a32"]).join(right, [*key, "b64", "b32"]).where("x <> y")
    return pairs.select(F.lit(table).alias("rec_table"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
