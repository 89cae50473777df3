"""Column expressions over text: predicates, keys, names and formats. All stay in the JVM but the exact lookup key."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode with the four separators of ASCII, the same class in Java's and RE2's syntax.
WS = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]"
#: Addresses that are never translated. Fixed value.
ADDRESS = r"(?:https?://|www\.|mailto:)[^\t-\r\x{1c}-\x{1f}\x{85}\p{Z}<>]+|[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
#: The same for Python: a letter that goes on an address can't begin one, so long words take linear time.
ADDRESS_PY = r"(?:https?://|www\.|mailto:)[^\s<>]+|(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
#: Display names of languages and their codes. Fixed values.
DISPLAY = {"Определить автоматически": "auto", "Авто": "auto", "Русский": "ru", "Английский": "en", "Английский (США)": "en", "Немецкий": "de", "Испанский": "es", "Французский": "fr", "Китайский": "zh", "Японский": "ja"}
#: Names that a file may not have. Fixed value.
RESERVED = r"(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])"
#: What is noise in a device's name, and what stands for it. Fixed values.
DEVICE_NOISE = ((r"(?i)\((?:R|TM)\)", ""), (r"(?i)\s+\d+-Core Processor\z", ""), (r"(?i)\s+CPU(?:\s+Processor)?\s*(?:@.*)?\z", ""), (r"\s+", " "), (r"^[ ,]+|[ ,]+\z", ""))
#: Limits. Fixed values.
MAX_TEXT, MAX_SEGMENT, MAX_NAME, MAX_LOOKUP = 50_000, 1200, 120, 160


def has_letter(text: Column) -> Column:
    """Whether any character is a letter; null for null."""
    return text.rlike(r"\p{L}")


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def is_blank(text: Column) -> Column:
    return F.length(F.regexp_replace(text, WS, "")) == 0


def language_code(name: Column) -> Column:
    """Code of a display name; other names in small letters."""
    table = F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv])
    return F.coalesce(table[name], F.lower(name))


def script_guess(token: Column) -> Column:
    """Language that a word's letters alone suggest: ru, en or auto."""
    return F.when(token.rlike(r"^[а-яёА-ЯЁ\x{301}]+\z"), "ru").when(token.rlike(r"^[a-zA-Z'’]+\z"), "en").otherwise("auto")


def main_script(text: Column) -> Column:
    """Language that most letters of a text suggest: ru, zh, ja or en; en for none. A stand-in where no better classifier is given."""
    n = lambda c: F.regexp_count(text, F.lit(c))
    kana, han, cyr, lat = n(r"[\x{3040}-\x{30ff}]"), n(r"[\x{4e00}-\x{9fff}]"), n(r"[\x{400}-\x{52f}]"), n("[A-Za-z]")
    return F.when(kana * 8 > han + kana, "ja").when(han > cyr + lat, "zh").when(cyr > lat, "ru").otherwise("en")


def addresses(text: Column) -> Column:
    """Array of the addresses in a text, in order."""
    some = text.rlike(r"@|://|www\.|mailto:")  # the full pattern is slow on long words, and few texts have addresses
    return F.when(some, F.regexp_extract_all(text, F.lit(f"({ADDRESS})"), F.lit(1))).when(text.isNotNull(), F.array().cast("array<string>"))


def between_addresses(text: Column) -> Column:
    """Array of the stretches before, between and after the addresses: one more than there are addresses."""
    return F.split(text, ADDRESS, -1)


def folded_key(text: Column) -> Column:
    """Lookup key: no stress marks, small letters with ß and ς opened, no white space at the ends.

    Texts are taken to be in composed form; for others use ``lookup_key``.
    """
    low = F.lower(F.replace(text, F.lit("́")))
    return strip(F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ")))


def _folded_exactly(texts):  # noqa: ANN001, ANN202 - a pandas function
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.replace("\u0301", "")).casefold().strip())


def lookup_key(text: Column) -> Column:
    """Exact lookup key with composition and full case folding, for texts in any form; null for null."""
    return F.pandas_udf(_folded_exactly, "string")(text)


def word_count(text: Column, language: Column) -> Column:
    """Words between white space; null for languages that write none between words."""
    return F.when(language.isin("zh", "ja"), F.lit(None).cast("int")).otherwise(F.size(F.filter(F.split(text, f"{WS}+"), lambda x: x != "")))


def restore_case(word: Column, like: Column) -> Column:
    """``word`` in the letter case of ``like``: all large, first large, or as it is."""
    cased = F.lower(like) != F.upper(like)
    first = F.substring(like, 1, 1)
    return (
        F.when(cased & (like == F.upper(like)), F.upper(word))
        .when((first == F.upper(first)) & (first != F.lower(first)), F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.length(word)))))
        .otherwise(word)
    )


def doubles_letter(short: Column, long: Column) -> Column:
    """Whether doubling one letter of ``short`` gives ``long``."""
    n = F.length(short)
    return (n > 0) & F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(short.substr(F.lit(1), i), short.substr(i, n)) == long)


def _clean(text: Column) -> Column:
    # characters that no file system takes: a fixed value
    return F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_")


def safe_name(text: Column) -> Column:
    """A directory or file name that every system accepts; never empty."""
    cut = F.substring(F.regexp_replace(_clean(text), r"^[ .]+|[ .]+\z", ""), 1, MAX_NAME)
    return F.when((cut == "") | cut.rlike(rf"^(?i){RESERVED}(?:\.|\z)"), F.concat(F.lit("_"), cut)).otherwise(cut)


def safe_base(text: Column, fallback: Column) -> Column:
    """A file's base name: the text if it makes one, else the fallback, else _document."""

    def candidate(c: Column) -> Column:
        cut = F.substring(F.regexp_replace(_clean(strip(c)), r"[ .]+\z", ""), 1, MAX_NAME)
        return F.when((cut != "") & ~cut.rlike(rf"^(?i){RESERVED}\z"), cut)

    return F.coalesce(candidate(text), candidate(fallback), F.lit("_document"))


def expand_template(template: Column, name: Column, lang: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{name}"), name), F.lit("{lang}"), lang)


def stem(file_name: Column) -> Column:
    """A file name without its last suffix; a leading period starts no suffix."""
    return F.regexp_replace(file_name, r"(?<=[^.])\.[^.]*\z", "")


def suffix(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"[^.](\.[^.]*)\z", 1)


def clock(seconds: Column) -> Column:
    """HH:MM:SS; null for null."""
    s = F.floor(seconds)
    return F.when(s.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def escape_markup(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def trim_punctuation(text: Column) -> Column:
    """A term without sentence marks, quotes and brackets (a fixed set) at its ends."""
    return F.btrim(text, F.lit(" .,!?;:。！？\"“”()[]"))


def device_name(text: Column, fallback: Column) -> Column:
    """A processor's or card's short name."""
    out = text
    for pattern, new in DEVICE_NOISE:
        out = F.regexp_replace(out, pattern, new)
    return F.when(text.isNull() | (out == ""), fallback).otherwise(out)


def outer_space(text: Column) -> tuple[Column, Column, Column]:
    """White space before, the core, and white space after; a blank text is all before."""
    lead = F.regexp_extract(text, rf"^({WS}*)", 1)
    rest = text.substr(F.length(lead) + 1, F.length(text))
    tail = F.regexp_extract(rest, rf"({WS}*)\z", 1)
    return lead, rest.substr(F.lit(1), F.length(rest) - F.length(tail)), tail


def inside(path: Column) -> Column:
    """Whether a relative path stays in its root: not absolute, no drive, never above the root."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda x: (x != "") & (x != "."))
    depth = F.aggregate(parts, F.array(F.lit(0), F.lit(0)), lambda a, x: F.array(a[0] + F.when(x == "..", -1).otherwise(1), F.least(a[1], a[0] + F.when(x == "..", -1).otherwise(1))))
    return ~path.rlike(r"^[/\\]|^[A-Za-z]:") & (depth[1] >= 0) & (path != "")
