"""Text cleaning as column expressions (JVM side, no Python per row)."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedback_engine.functions.scalars import let
from feedback_engine.functions.wordlists import NULL_LIKE, SOURCE_DISPLAY, STOPWORD_PROFILES

# Whitespace in the Unicode sense, written so that Java reads it the same way everywhere.
SPACES = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
URL_PATTERN = r"http\S+|www\.\S+"
# Letters without a canonical decomposition and their usual ASCII spelling.
_LONG_SPELLINGS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ĳ", "ij"), ("ŋ", "ng"))
_SHORT_SPELLINGS = dict(zip("øđðłħŧıªº¹²³", "oddlhtiao123"))


def _latin_map() -> tuple[str, str]:
    """Lower-case Latin letters that decompose to an ASCII letter plus marks."""
    pairs = dict(_SHORT_SPELLINGS)
    for point in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        char = chr(point)
        base = unicodedata.normalize("NFD", char)[0]
        if char.lower() == char and base != char and "a" <= base <= "z":
            pairs[char] = base
    return "".join(pairs), "".join(pairs.values())


_LATIN_FROM, _LATIN_TO = _latin_map()


# Usual ASCII spellings of the small Greek and Cyrillic letters.
_GREEK = dict(zip("αβγδεζηικλμνξοπρσςτυω", "abgdezeiklmnxoprsstuo")) | {"θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps"}
_CYRILLIC = dict(zip("абвгдезийклмнопрстуфыэіјґ", "abvgdeziiklmnoprstufyeijg")) | {
    "ё": "io", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": '"', "ь": "'", "ю": "iu", "я": "ia",
    "ђ": "dj", "ѓ": "gj", "є": "ie", "ѕ": "dz", "ї": "yi", "љ": "lj", "њ": "nj", "ћ": "tsh", "ќ": "kj", "ў": "u", "џ": "dzh",
}
_OTHER_SCRIPTS = (0x0370, 0x0500)


def _script_table() -> list[str]:
    """Spelling of each code point of the two blocks: accented letters as their base, unknown signs a blank."""
    spelled = _GREEK | _CYRILLIC

    def spelling(char: str) -> str:
        return spelled.get(char) or spelled.get(unicodedata.normalize("NFD", char)[0], " ")

    return [spelling(chr(point)) for point in range(*_OTHER_SCRIPTS)]


_SCRIPT_TABLE = _script_table()


def _latin_letters(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), r"[\x{0300}-\x{036F}\x{10000}-\x{10FFFF}]", "")
    for char, spelling in _LONG_SPELLINGS:
        out = F.replace(out, F.lit(char), F.lit(spelling))
    return F.translate(out, _LATIN_FROM, _LATIN_TO)


def _other_letters(text: Column) -> Column:
    """Greek and Cyrillic letters by their place in one table, sign by sign."""
    first, end = _OTHER_SCRIPTS
    table = F.from_json(F.lit(json.dumps(_SCRIPT_TABLE)), "array<string>")

    def spelled(char: Column) -> Column:
        point = F.ascii(char)
        return F.when((point >= first) & (point < end), F.get(table, point - first)).otherwise(char)

    return F.array_join(F.transform(F.split(text, ""), spelled), "")


def transliterate(text: Column) -> Column:
    """Lower-case text to ASCII letters; symbols outside the basic plane are deleted.

    Only rows with a Greek or Cyrillic letter are read sign by sign, and ASCII rows are only lowered. Letters of other scripts
    stay as they are.
    """
    latin = _latin_letters(text)
    other = text.rlike(r"[\x{0370}-\x{04FF}]")
    spelled = F.when(other, _other_letters(latin)).otherwise(latin)
    return F.when(F.octet_length(text) > F.length(text), spelled).otherwise(F.lower(text))


def _without_urls(text: Column) -> Column:
    """URLs to space; the pattern only reads rows that hold its first letters."""

    def cleared(held: Column) -> Column:
        found = held.contains("http") | held.contains("www.")
        return F.when(found, F.regexp_replace(held, URL_PATTERN, " ")).otherwise(held)

    return let(text, cleared)


def normalize_text(text: Column) -> Column:
    """Lower, transliterate, URLs to space, keep [a-z0-9], collapse and trim."""
    out = _without_urls(transliterate(text))
    # One pass does "other characters to space" and "collapse runs".
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def tokenize(text: Column) -> Column:
    """All runs of [a-z0-9] in the lowered text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def split_words(text: Column) -> Column:
    """Whitespace tokens, no empty ones."""
    return F.filter(F.split(text, rf"[{SPACES}]+"), lambda w: w != "")


def stopword_set(profile: str, brand_terms: Iterable[str] = ()) -> list[str]:
    if profile not in STOPWORD_PROFILES:
        raise ValueError(f"unknown stopword profile: {profile}")
    return sorted(STOPWORD_PROFILES[profile] | set(brand_terms))


def drop_stopwords(tokens: Column, stopwords: Iterable[str]) -> Column:
    """Keep tokens outside the set (Catalyst turns the long IN into a hash set)."""
    words = list(stopwords)
    return F.filter(tokens, lambda w: ~w.isin(words))


def remove_stopwords(
    text: Column,
    profile: str = "sentiment",
    language: str = "portuguese",
    brand_terms: Iterable[str] = (),
) -> Column:
    if language != "portuguese":
        raise ValueError(f"unsupported stopword language: {language}")
    return F.array_join(drop_stopwords(tokenize(text), stopword_set(profile, brand_terms)), " ")


def clean_tokens(
    text: Column, profile: str = "sentiment", brand_terms: Iterable[str] = ()
) -> Column:
    """Normalised text as stopword-free tokens; normalised text only holds [a-z0-9 ]."""
    words = F.split(normalize_text(F.coalesce(text, F.lit(""))), " ")
    return drop_stopwords(words, ["", *stopword_set(profile, brand_terms)])


def clean_text(
    text: Column, profile: str = "sentiment", brand_terms: Iterable[str] = ()
) -> Column:
    """Null becomes ''; normalise and drop stopwords."""
    return F.array_join(clean_tokens(text, profile, brand_terms), " ")


def clean_complaint(text: Column) -> Column:
    """Complaint cleaner: keeps accents (the range à-ú, which holds ÷ as well)."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, rf"http[^{SPACES}]+", "")
    out = F.regexp_replace(out, r"[^a-zà-ú0-9]+", " ")
    return F.trim(out)


def compose_complaint_text(subject: Column, problem: Column, category: Column) -> Column:
    """``Assunto: a | Problema: p | Categoria: c``; an empty middle part keeps its separator."""

    def part(title: str, value: Column) -> Column:
        text = F.trim(F.coalesce(value, F.lit("")))
        return F.when(text != "", F.concat(F.lit(f"{title}: "), text)).otherwise(F.lit(""))

    joined = F.concat(
        part("Assunto", subject),
        F.lit(" | "),
        part("Problema", problem),
        F.lit(" | "),
        part("Categoria", category),
    )
    return F.regexp_replace(joined, r"^[ |]+|[ |]+$", "")


def clean_context_value(value: Column) -> Column:
    """Collapse spaces; words that stand for a missing value become ''."""
    out = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), rf"[{SPACES}]+", " "))
    return F.when(F.lower(out).isin(*NULL_LIKE), F.lit("")).otherwise(out)


def context_text(
    source: Column,
    category: Column,
    theme: Column,
    status: Column,
    raw_text: Column,
    clean: Column,
) -> Column:
    """``fonte: … | categoria: … | status: … | texto: …`` without the empty parts."""

    def filled(value: Column) -> Column:
        out = clean_context_value(value)
        return F.when(out != "", out)

    def part(title: str, value: Column) -> Column:
        return F.concat(F.lit(f"{title}: "), value)

    joined = F.concat_ws(
        " | ",
        part("fonte", source_display(filled(source))),
        part("categoria", F.coalesce(filled(category), filled(theme))),
        part("status", filled(status)),
        part("texto", F.coalesce(filled(raw_text), filled(clean))),
    )
    return F.when(joined != "", joined).otherwise(F.coalesce(raw_text, clean, F.lit("")))


def source_display(source: Column) -> Column:
    """Display name of a feed: known names, else words with a capital."""
    names = F.create_map(*[F.lit(x) for pair in SOURCE_DISPLAY.items() for x in pair])
    return F.coalesce(names[source], F.initcap(F.replace(source, F.lit("_"), F.lit(" "))))


def is_keyword(token: Column) -> Column:
    """At least three characters and not only digits."""
    return (F.length(token) >= 3) & ~token.rlike(r"^\d+$")


def format_keyword(keyword: Column) -> Column:
    """Underscores to spaces, trimmed, first letter upper."""
    text = F.trim(F.replace(keyword, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def last_path_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)
