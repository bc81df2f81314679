"""Text normalisation on built-in functions: search keys, report text, slugs, titles, languages."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, for classes in regular expressions: what Unicode calls White_Space, and the zero-width no-break space.
SPACES = r"\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# Text that was read in a wrong encoding, and what it stands for; replaced in this order.
MOJIBAKE = (
    ("É™", "ə"), ("Æ\u008f", "Ə"), ("Ä±", "ı"), ("Ä°", "İ"), ("ÄŸ", "ğ"), ("Äž", "Ğ"), ("ÅŸ", "ş"), ("Åž", "Ş"),
    ("Ã§", "ç"), ("Ã‡", "Ç"), ("Ã¶", "ö"), ("Ã–", "Ö"), ("Ã¼", "ü"), ("Ãœ", "Ü"),
)

# Language codes in their order, the names that are accepted for them, and their scripts.
LANGUAGES = ("aze", "eng", "rus", "uzb", "tur")
LANGUAGE_NAMES = {"az": "aze", "aze": "aze", "en": "eng", "eng": "eng", "ru": "rus", "rus": "rus", "uz": "uzb", "uzb": "uzb", "tr": "tur", "tur": "tur"}
LANGUAGE_SCRIPTS = {"aze": "latin", "eng": "latin", "uzb": "latin", "tur": "latin", "rus": "cyrillic"}


@cache
def decompositions() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """From Unicode data: characters and the single base characters they decompose to (for translate), and those that
    decompose to several. Combining marks are dropped from the results; Hangul syllables, which are letters on their own in
    a search key, are left alone."""
    one, base, several = [], [], []
    for point in [*range(0x80, 0xAC00), *range(0xF900, 0x10000)]:
        c = chr(point)
        if 0xD800 <= point < 0xE000:
            continue
        flat = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))
        if flat == c or unicodedata.category(c).startswith("M"):
            continue
        if len(flat) == 1:
            one.append(c)
            base.append(flat)
        elif flat and not flat.isspace():
            several.append((c, flat))
    return "".join(one), "".join(base), tuple(several)


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_marks(s: Column) -> Column:
    """Compatibility decomposition without its combining marks."""
    one, base, several = decompositions()
    # Ligatures, fractions and the like are rare: only texts that hold one take the long way.
    rare = F.split(F.lit("\n".join(c + flat for c, flat in several)), "\n")
    spelled = lambda x: F.aggregate(rare, x, lambda a, r: F.replace(a, F.substring(r, 1, 1), F.substring(r, 2, 40)))
    # All of them lie in these ranges, which are quick to test; the class of a thousand characters is not.
    some = "[" + "".join(c for c, _ in several) + "]"
    maybe = r"[\x{BC}-\x{BE}\x{0100}-\x{FFFF}]"
    flat = let(F.translate(s, one, base), lambda x: F.when(x.rlike(maybe) & x.rlike(some), spelled(x)).otherwise(x))
    return F.regexp_replace(flat, r"\p{M}+", "")


def normalize_token(s: Column) -> Column:
    """Lower case, no marks, no schwa, no modifier letters; ends that aren't letters, numbers or dashes are cut."""
    flat = F.translate(without_marks(F.lower(s)), "ıə", "i")
    return F.regexp_replace(F.regexp_replace(flat, r"\p{Lm}+", ""), r"^[^\p{L}\p{N}\p{Pd}]+|[^\p{L}\p{N}\p{Pd}]+$", "")


def _letters(s: Column, besides: str) -> Column:
    """normalize_token without anything but letters, numbers and `besides`, in one pass; texts of ASCII alone need no decomposition."""
    one, base, several = decompositions()
    rare = F.split(F.lit("\n".join(c + flat for c, flat in several)), "\n")
    spelled = lambda x: F.aggregate(rare, x, lambda a, r: F.replace(a, F.substring(r, 1, 1), F.substring(r, 2, 40)))
    some = "[" + "".join(c for c, _ in several) + "]"
    flat = lambda x: let(F.translate(x, one, base), lambda y: F.translate(F.when(y.rlike(r"[\x{BC}-\x{BE}\x{0100}-\x{FFFF}]") & y.rlike(some), spelled(y)).otherwise(y), "ıə", "i"))
    lower = let(F.lower(s), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), flat(x)).otherwise(x))
    return F.regexp_replace(lower, rf"[\p{{Lm}}[^\p{{L}}\p{{N}}{besides}]]+", "")


def normalize_for_search(s: Column) -> Column:
    """normalize_token without anything but letters and numbers, so that spaces vanish."""
    return _letters(s, "")


def normalized_words(words: Column) -> Column:
    """Search keys of an array of words, which hold no line feed, in one pass over all of them; a null word is an empty one."""
    return F.when(F.size(words) > 0, F.split(_letters(F.array_join(words, "\n", ""), r"\n"), "\n", -1)).otherwise(F.array().cast("array<string>"))


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{SPACES}]+|[{SPACES}]+$", "")


def clean_report_text(s: Column, most: int = 4000) -> Column:
    """Legacy fonts decoded, mojibake replaced, unprintable characters and white space as single spaces, `most` characters."""
    from folioscope.functions.encoding import decoded

    def replaced(text: Column) -> Column:
        out = text
        for broken, repaired in MOJIBAKE:
            out = F.replace(out, F.lit(broken), F.lit(repaired))
        return F.when(text.rlike("[ÃÄÅÆÉ]"), out).otherwise(text)

    text = F.regexp_replace(let(decoded(s), replaced), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{E000}-\x{F8FF}\x{FFFD}]", " ")
    return F.substring(trimmed(F.regexp_replace(text, f"[{SPACES}]+", " ")), 1, most)


def slug(s: Column, most: int = 60) -> Column:
    flat = F.lower(F.translate(without_marks(s), "əƏıİğĞşŞçÇöÖüÜ", "eeiigGsScCoOuU"))
    flat = F.regexp_replace(F.regexp_replace(flat, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    flat = F.regexp_replace(F.substring(flat, 1, most), "-+$", "")
    return F.coalesce(F.nullif(flat, F.lit("")), F.lit("item"))


def readable(s: Column) -> Column:
    """Without replacement characters, private-use characters and controls."""
    return F.regexp_replace(s, r"[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def line_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), f"[{SPACES}]+", " ")


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(f"[^{SPACES}]+"), F.lit(0))


def word_count(s: Column) -> Column:
    return F.size(tokens(s))


def title_from_text(s: Column, most: int = 250) -> Column:
    """The first line that is a title: three characters or more, one of them a letter."""
    lines = F.transform(F.split(s, r"\r?\n"), lambda x: clean_report_text(x, most))
    fit = F.filter(lines, lambda x: (F.length(x) >= 3) & x.rlike(r"\p{L}"))
    return F.coalesce(F.get(fit, F.lit(0)), F.lit(""))


def parsed_languages(s: Column) -> Column:
    """The codes of a list such as `az+en`, in their order; null if it is empty or has an unknown name."""
    names = F.filter(F.transform(F.split(F.lower(F.coalesce(s, F.lit(""))), "[+,]"), trimmed), lambda x: x != "")
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))
    codes = F.transform(names, lambda x: F.element_at(known, x))
    in_order = F.filter(F.array(*map(F.lit, LANGUAGES)), lambda c: F.array_contains(F.filter(codes, lambda x: x.isNotNull()), c))
    return F.when((F.size(names) > 0) & ~F.exists(codes, lambda x: x.isNull()), in_order)


def serialized_languages(codes: Column) -> Column:
    return F.when(codes.isNotNull(), F.array_join(F.filter(F.array(*map(F.lit, LANGUAGES)), lambda c: F.array_contains(codes, c)), "+"))


def scripts_of(s: Column) -> Column:
    """The scripts of a language list; Latin where it isn't understood."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_SCRIPTS.items() for x in pair))
    return F.array_distinct(F.transform(F.coalesce(parsed_languages(s), F.array(F.lit("eng"))), lambda c: F.element_at(known, c)))


def origin_allowed(origin: Column, allowed: list[str]) -> Column:
    """Whether the origin is one of those allowed; a star stands for anything."""
    import re

    out = F.lit(False)
    for a in allowed:
        out = out | (origin == a)
        if "*" in a:
            out = out | origin.rlike("^" + ".*".join(re.escape(x) for x in a.split("*")) + r"\z")
    return out


def viewer_name(name: Column) -> Column:
    """The name under which a document is shown: its extension becomes .pdf."""
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")), F.lit(".pdf"))


def number_setting(s: Column, fallback: float) -> Column:
    """A number of 0 or more from a setting; blank and other texts give the fallback."""
    x = trimmed(s).try_cast("double")
    return F.when((x >= 0) & (x < float("inf")), x).otherwise(F.lit(float(fallback)))


def positive_setting(s: Column, fallback: float, most: float | None = None, whole: bool = False) -> Column:
    """A number over 0 (whole: of 1 or more, cut to an integer), `most` at most; other texts give the fallback."""
    x = trimmed(s).try_cast("double")
    fit = (x >= 1 if whole else x > 0) & (x < float("inf"))
    x = F.when(fit, F.floor(x).cast("double") if whole else x)
    return F.when(fit, F.least(x, F.lit(float(most))) if most is not None else x).otherwise(F.lit(float(fallback)))
