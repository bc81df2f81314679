"""Repairs of recognised Azerbaijani text: lost schwas, breves read for umlauts, consonants that stand alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.glyphs import chars, glyph_width
from folioscope.functions.text import let

# Fixed values.
VOWELS = "aeiouəıöüAEIOUƏIİÖÜ"
LEAST_GAP, SCALE_RANK, MOST_INSERTED, LEAST_PAIRS = 0.30, 0.4, 2, 3
MISREAD_CAPITAL = "∃∀"


def needs_repair(languages: Column) -> Column:
    """Whether Azerbaijani is among the languages."""
    return languages.rlike(r"(?i)(^|[^A-Za-z0-9_])aze?($|[^A-Za-z0-9_])") | languages.contains("aze")


def nearest_rank(sorted_: Column, fraction: float) -> Column:
    """The element at the rounded place; halves round up. 0 for an empty array."""
    at = F.floor((F.size(sorted_) - 1) * F.lit(fraction) + 0.5)
    return F.coalesce(F.get(sorted_, F.greatest(F.lit(0), at).cast("int")), F.lit(0.0))


def umlauts(s: Column) -> Column:
    """A breve g between two consonants becomes an umlaut u. From left to right: a letter that was changed counts as a vowel."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    consonant = lambda c: F.coalesce(c.rlike(r"^\p{L}$") & ~F.lit(VOWELS).contains(c), F.lit(False))
    triples = F.transform(chars, lambda c, i: F.struct(c.alias("c"), consonant(F.get(chars, i + 1)).alias("after")))

    def step(a: Column, t: Column) -> Column:
        change = t["c"].isin("ğ", "Ğ") & t["after"] & consonant(F.when(a != "", F.substring(a, -1, 1)))
        return F.concat(a, F.when(change, F.translate(t["c"], "ğĞ", "üÜ")).otherwise(t["c"]))

    return F.when(s.rlike("[ğĞ]"), F.aggregate(triples, F.lit(""), step)).otherwise(s)


def lone_consonants(s: Column) -> Column:
    """A lower-case letter that stands alone and is no vowel gains a schwa."""
    return F.regexp_replace(s, r"(^|[^\p{L}])([\p{Ll}&&[^aeiouəıöü]])(?=$|[^\p{L}])", "$1$2ə")


def restored_schwa(text: Column, offsets: Column) -> Column:
    """struct(text, char_offsets, inserted): schwas where the centres of two consonants lie further apart than their widths explain.

    Only the line's scale is shared, a low rank of all gaps between letters by their widths; each place is then judged by itself.
    Offsets that don't fit the text, and texts without enough gaps, are left as they are; a null text stays null.
    """
    letter, capital = (lambda c: F.coalesce(c.rlike(r"^\p{L}$"), F.lit(False))), (lambda c: F.coalesce(c.rlike(r"^\p{Lu}$"), F.lit(False)))
    vowel = lambda c: F.lit(VOWELS).contains(c)

    def measured(x: Column) -> Column:
        """For each character but the last: whether a gap between letters follows, whether a schwa may be in it, the gap and what explains it."""
        c, at, wide = x["c"], x["at"], x["wide"]
        pair = lambda i: F.struct((letter(F.get(c, i)) & letter(F.get(c, i + 1))).alias("ok"), (~vowel(F.get(c, i)) & ~vowel(F.get(c, i + 1))).alias("open"), (F.get(at, i + 1) - F.get(at, i)).alias("gap"), ((F.get(wide, i) + F.get(wide, i + 1)) / 2).alias("expected"), F.when(capital(F.get(c, i)) & capital(F.get(c, i + 1)), "Ə").otherwise("ə").alias("schwa"))
        return F.transform(F.sequence(F.lit(0), F.size(c) - 2), pair)

    def counted(x: Column, pairs: Column) -> Column:
        told = F.filter(pairs, lambda p: p["ok"])
        scale = nearest_rank(F.array_sort(F.transform(told, lambda p: p["gap"] / p["expected"])), SCALE_RANK)
        enough = (F.size(told) >= LEAST_PAIRS) & F.exists(told, lambda p: p["open"])
        missing = lambda p, s: p["gap"] / s - p["expected"]
        many = lambda p, s: F.when(p["ok"] & p["open"] & (missing(p, s) >= LEAST_GAP), F.least(F.lit(MOST_INSERTED), F.greatest(F.lit(1), F.floor(missing(p, s) / glyph_width(p["schwa"])).cast("int")))).otherwise(0)
        return let(scale, lambda s: F.transform(pairs, lambda p: F.when(enough & (s > 0), many(p, s)).otherwise(0)))

    def filled(x: Column, pairs: Column, n: Column) -> Column:
        c, at = x["c"], x["at"]
        times = lambda i: F.coalesce(F.get(n, i), F.lit(0))
        out = F.array_join(F.transform(c, lambda v, i: F.concat(v, F.repeat(F.coalesce(F.get(pairs, i)["schwa"], F.lit("")), times(i)))), "")
        places = lambda v, i: F.concat(F.array(v), F.when(times(i) > 0, F.transform(F.sequence(F.lit(1), F.greatest(times(i), F.lit(1))), lambda k: v + F.get(pairs, i)["gap"] * k / (times(i) + 1))).otherwise(F.array().cast("array<double>")))
        return F.struct(out.alias("text"), F.flatten(F.transform(at, places)).alias("char_offsets"), F.aggregate(n, F.lit(0), lambda a, v: a + v).alias("inserted"))

    def by(x: Column) -> Column:
        same = F.struct(x["t"].alias("text"), x["at"].alias("char_offsets"), F.lit(0).alias("inserted"))
        work = let(measured(x), lambda p: let(counted(x, p), lambda n: filled(x, p, n)))
        return F.when((F.size(x["at"]) == F.size(x["c"])) & (F.size(x["c"]) >= 2), work).otherwise(same)

    told = F.translate(text, MISREAD_CAPITAL, "Ə" * len(MISREAD_CAPITAL))
    held = let(told, lambda t: F.struct(t.alias("t"), chars(t).alias("c"), F.coalesce(offsets.cast("array<double>"), F.array().cast("array<double>")).alias("at"), F.transform(chars(t), glyph_width).alias("wide")))
    nothing = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<double>").alias("char_offsets"), F.lit(0).alias("inserted"))
    return F.when(text.isNull(), nothing).otherwise(let(held, by))


def repaired_lines(lines, languages: Column):  # noqa: ANN001, ANN201
    """lines (text, char_offsets, ...) repaired where the languages ask for it; offsets that no longer fit become null."""
    asked = lines.withColumn("__repair", F.when(needs_repair(languages), restored_schwa(F.col("text"), F.col("char_offsets"))))
    text = lone_consonants(umlauts(F.col("__repair.text")))
    asked = asked.withColumn("__text", F.coalesce(text, F.col("text")))
    same = F.col("__text") == F.col("text")
    offsets = F.when(same, F.col("char_offsets")).when(F.col("__text") == F.col("__repair.text"), F.col("__repair.char_offsets"))
    return asked.withColumn("char_offsets", offsets).withColumn("text", F.col("__text")).drop("__repair", "__text")
