"""Widths of glyphs in ems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and their widths.
WIDTH_OF = {
    " ": 0.32, "a": 0.61, "b": 0.64, "c": 0.55, "d": 0.64, "e": 0.61, "f": 0.35, "g": 0.64, "h": 0.63, "i": 0.28, "j": 0.28, "k": 0.58, "l": 0.28,
    "m": 0.97, "n": 0.63, "o": 0.61, "p": 0.64, "q": 0.64, "r": 0.41, "s": 0.52, "t": 0.39, "u": 0.63, "v": 0.59, "w": 0.82, "x": 0.59, "y": 0.59, "z": 0.52,
    "A": 0.68, "B": 0.69, "C": 0.70, "D": 0.77, "E": 0.63, "F": 0.58, "G": 0.78, "H": 0.75, "I": 0.29, "J": 0.29, "K": 0.67, "L": 0.56, "M": 0.86,
    "N": 0.75, "O": 0.79, "P": 0.60, "Q": 0.79, "R": 0.70, "S": 0.65, "T": 0.61, "U": 0.73, "V": 0.68, "W": 0.99, "X": 0.68, "Y": 0.61, "Z": 0.61,
    "ə": 0.61, "Ə": 0.63, "ı": 0.28, "İ": 0.29, "ğ": 0.64, "Ğ": 0.78, "ş": 0.52, "Ş": 0.65, "ç": 0.55, "Ç": 0.70, "ö": 0.61, "Ö": 0.79, "ü": 0.63, "Ü": 0.73,
    ".": 0.32, ",": 0.32, ";": 0.34, ":": 0.34, "!": 0.36, "?": 0.52, "'": 0.27, '"': 0.42, "`": 0.50, "-": 0.36, "(": 0.39, ")": 0.39, "[": 0.39, "]": 0.39,
    "{": 0.40, "}": 0.40, "/": 0.34, "\\": 0.34, "@": 1.00, "%": 0.98, "#": 0.64, "&": 0.73,
}
DIGIT, CAPITAL, OTHER = 0.64, 0.70, 0.61
#: The characters of each width.
WIDTHS = {w: "".join(c for c, x in WIDTH_OF.items() if x == w) for w in sorted(set(WIDTH_OF.values()))}


def glyph_width(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in WIDTH_OF.items() for x in pair))
    return F.coalesce(F.try_element_at(known, c), F.when(c.rlike("^[0-9]$"), DIGIT).when(c.rlike(r"\p{Lu}"), CAPITAL).otherwise(OTHER))


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def text_width(s: Column) -> Column:
    """The sum of the widths: characters of one width are counted at once."""
    named = "".join(WIDTH_OF)
    import re

    cls = lambda cs: "[" + re.escape(cs).replace('"', '\\"') + "]"
    parts = [F.regexp_count(s, F.lit(cls(cs))) * F.lit(w) for w, cs in WIDTHS.items()]
    rest = F.regexp_replace(s, cls(named), "")
    digits, capitals = F.regexp_count(rest, F.lit("[0-9]")), F.regexp_count(rest, F.lit(r"\p{Lu}"))
    parts += [digits * F.lit(DIGIT), capitals * F.lit(CAPITAL), (F.length(rest) - digits - capitals) * F.lit(OTHER)]
    return reduce(lambda a, b: a + b, parts)


def width_prefix(s: Column) -> Column:
    """Widths up to each character: one more than there are characters, from 0."""
    return F.aggregate(F.transform(chars(s), glyph_width), F.array(F.lit(0.0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + w)))


def expected_gap(left: Column, right: Column) -> Column:
    """Between the centres of two neighbours."""
    return (glyph_width(left) + glyph_width(right)) / 2
