"""Languages: codes, spellings of labels, scripts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages that have a profile. Fixed values.
LANGS = ("de", "en", "es", "fr", "hi", "ja", "pt", "ru", "th", "uk", "zh")

#: Spellings of a language beside its two-letter code: three-letter codes, English, Russian and own names. Fixed values.
SPELLINGS = {
    "de": "deu ger german deutsch немецкий німецька allemand alemán",
    "en": "eng english английский англійська anglais inglés englisch",
    "es": "spa spanish español испанский іспанська castellano espagnol spanisch",
    "fr": "fra fre french français francais французский французька francés französisch",
    "hi": "hin hindi हिन्दी हिंदी хинди гінді",
    "ja": "jpn japanese 日本語 японский японська jp",
    "pt": "por portuguese português portugues португальский португальська",
    "ru": "rus russian русский російська russe ruso russisch",
    "th": "tha thai ไทย ภาษาไทย тайский тайська",
    "uk": "ukr ukrainian українська украинский ua",
    "zh": "zho chi chinese 中文 汉语 漢語 китайский китайська cmn cn",
    "it": "ita italian italiano итальянский",
    "pl": "pol polish polski польский",
    "ko": "kor korean 한국어 корейский",
    "ar": "ara arabic العربية арабский",
    "tr": "tur turkish türkçe турецкий",
    "nl": "nld dut dutch nederlands нидерландский",
    "cs": "ces cze czech čeština чешский",
    "vi": "vie vietnamese вьетнамский",
    "sv": "swe swedish svenska шведский",
    "be": "bel belarusian беларуская белорусский",
}


@lru_cache(1)
def spelling_map() -> dict[str, str]:
    out = {code: code for code in SPELLINGS}
    for code, names in SPELLINGS.items():
        out.update(dict.fromkeys(names.split(), code))
    return out


def label_code(label: Column) -> Column:
    """Two-letter code that a declared label names, or null if it names none.

    Null, blank, automatic, unknown and unreadable labels give null; region and script suffixes
    ("ru-RU", "de_DE", "zh-Hans") and letter case don't matter.
    """
    pairs = [F.lit(x) for kv in spelling_map().items() for x in kv]
    known = F.create_map(*pairs)
    plain = F.lower(F.regexp_replace(label, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))
    head = F.regexp_extract(plain, r"(?U)^([^-_(\s]+)", 1)
    return F.coalesce(known[plain], known[head])
