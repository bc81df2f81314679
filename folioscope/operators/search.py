"""Keyword search: whole words on text without spaces.

A match begins where a word begins and ends where a word ends, so syllables that were split into several boxes match
together and a keyword doesn't match inside a longer word. A line's spans from word to word, of the needles' lengths only, are
hashed and meet a bit table of all needles' hashes inside the scan's projection, so the work grows with the text and not with
the number of keywords. Lines that pass, few of which don't hit, are placed and meet the needles by an equi-join on the hash; the
match itself confirms.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import let, normalize_for_search, normalized_words
from folioscope.operators.layout import GLUE, box
from folioscope.schema import AUTO_COLOR, AUTO_OPACITY

LITERAL = 256
#: Bits of the table for each needle, and at most: 1 MB.
BITS, MOST_BITS = 64, 1 << 23
#: Lengths of needles that are told apart; longer ones are all tried.
LENGTHS = 1 << 12
#: Characters of a needle that are looked for first, where a word begins: FIRST of them in a set of FIRSTS at most, then HEAD in the table.
HEAD, FIRST, FIRSTS = 6, 3, 4096
#: Needles that may be broadcast; they are counted first. Of a few hundred bytes at most each.
SMALL = 50_000


def needles(keywords: DataFrame) -> DataFrame:
    """keywords (keyword, ...) with needle; those without a usable one go. Spellings that repeat stay."""
    return keywords.withColumn("needle", normalize_for_search(F.col("keyword"))).filter("needle <> ''")


def flattened(lines: DataFrame) -> DataFrame:
    """lines with search_text and flat: for each word with text its place, start, end, and whether it goes on before or after."""
    w = F.col("words")

    def glued(i: Column) -> Column:
        a, b = F.get(w, i), F.get(w, i + 1)
        return F.coalesce(b["x"] - (a["x"] + a["width"]) < F.greatest(a["height"], b["height"]) * GLUE, F.lit(False))

    dash = lambda i: F.coalesce(F.get(w, i)["text"].rlike(r"\p{Pd}\s*$"), F.lit(False))
    lines = lines.withColumn("__norm", F.transform(w, lambda x: normalize_for_search(x["text"])))
    lines = lines.withColumn("search_text", F.array_join("__norm", ""))
    size = F.size(w)

    def flat(x: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(F.col("__norm"), F.lit(1), i), F.lit(0), lambda a, t: a + F.length(t))
        before = F.when(i == 0, F.coalesce(F.col("after_dash"), F.lit(False))).otherwise(glued(i - 1))
        after = F.when(i == size - 1, dash(i)).otherwise(glued(i))
        return F.struct(i.alias("i"), start.alias("start"), (start + F.length(x)).alias("end"), before.alias("before"), after.alias("after"))

    return lines.withColumn("flat", F.filter(F.transform("__norm", flat), lambda f: f["end"] > f["start"])).drop("__norm")


def _matches(text: Column, flat: Column, needle: Column) -> Column:
    """Array of struct(at, from, to): matches from the left, none overlapping."""
    n = F.length(needle)

    def ends(f: Column) -> Column:
        return F.filter(flat, lambda g: (g["end"] == f["start"] + n) & ~g["after"])

    hits = F.filter(flat, lambda f: ~f["before"] & (F.substring(text, f["start"] + 1, n) == needle) & (F.size(ends(f)) > 0))
    hits = F.transform(hits, lambda f: F.struct(f["start"].alias("at"), f["i"].alias("from"), F.get(ends(f), F.lit(0))["i"].alias("to")))
    kind = "array<struct<at:int,from:int,to:int>>"

    def take(a: Column, h: Column) -> Column:
        ok = (F.size(a) == 0) | (h["at"] >= F.element_at(a, -1)["at"] + n)
        return F.when(ok, F.concat(a, F.array(h))).otherwise(a)

    return F.when(F.size(hits) > 0, F.aggregate(hits, F.array().cast(kind), take))


def _highlights(hits: DataFrame) -> DataFrame:
    """hits: lines with flat, words, keyword, m (a match)."""
    covered = F.filter(F.slice("words", F.col("m.from") + 1, F.col("m.to") - F.col("m.from") + 1), lambda w: normalize_for_search(w["text"]) != "")
    hits = hits.withColumn("covered", covered).withColumn("b", box(F.col("covered")))
    return hits.select("document_id", "page_number", "line", F.col("m.at").alias("start_at"), "keyword_id", "keyword", F.size("covered").alias("n_words"), "b.x", "b.y", "b.width", "b.height", F.lit(AUTO_COLOR).alias("color"), F.lit(AUTO_OPACITY).alias("opacity"), F.lit("AUTO").alias("source"))


@dataclass
class Needles:
    """What is told of all needles to the scan: their number, a bit table of their hashes, and which lengths they have."""

    count: int
    words: Column
    bits: int
    lengths: Column
    heads: list[int]
    firsts: list[str] | None


def needle_table(wanted: DataFrame) -> Needles:
    """wanted: needle. Collects the table's words of 64 bits, MOST_BITS bits at most, and the lengths up to LENGTHS."""
    sized = wanted.select("needle", F.least(F.length("needle"), F.lit(LENGTHS)).alias("n"))
    have = {r.n: r.many for r in sized.groupBy("n").agg(F.count(F.lit(1)).alias("many")).collect()}
    count, bits = sum(have.values()), 1 << 12
    while bits < min(MOST_BITS, BITS * count):
        bits *= 2
    # Heads are told apart from whole needles by their hash's seed.
    h = F.col("h")
    of = wanted.select(F.explode(F.array(F.xxhash64("needle"), _head(F.substring("needle", 1, HEAD)))).alias("h"))
    places = of.select(F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))).alias("at"))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    held = {r.word: r.x for r in places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("x")).collect()}
    listed = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")
    firsts = [r.f for r in wanted.select(F.substring("needle", 1, FIRST).alias("f")).distinct().limit(FIRSTS + 1).collect()]
    return Needles(count, listed((held.get(i, 0) for i in range(bits // 64)), "bigint"), bits, listed((int(i in have) for i in range(LENGTHS + 1)), "int"), sorted({min(n, HEAD) for n in have}), sorted(firsts) if len(firsts) <= FIRSTS else None)


def _head(s: Column) -> Column:
    return F.xxhash64(s, F.lit(1))


def span_hashes(keys: Column, told: Needles) -> Column:
    """Hashes of a line's spans from word to word that are in the table; keys: the search keys of its words."""
    joined = F.array_join(keys, "")
    ends = F.aggregate(F.transform(keys, lambda k: F.length(k)), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    held = lambda x: F.getbit(F.get(told.words, F.shiftright(x, 6).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1
    both = lambda h: held(h.bitwiseAND(F.lit(told.bits - 1))) & held(F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(told.bits - 1)))

    def hashed(text: Column, at: Column) -> Column:
        first = lambda start, n: F.substring(text, start + 1, F.lit(n)).isin(*(f for f in told.firsts if len(f) == n))
        maybe = lambda start: reduce(or_, (first(start, n) for n in sorted({len(f) for f in told.firsts}, reverse=True))) if told.firsts else F.lit(True)
        heads = lambda start: maybe(start) & F.exists(F.array(*(_head(F.substring(text, start + 1, F.lit(n))) for n in told.heads)), both)
        fit = lambda start, end: (end > start) & (F.get(told.lengths, F.least(end - start, F.lit(LENGTHS))) == 1)
        of = lambda start: F.transform(F.filter(at, lambda end: fit(start, end)), lambda end: F.xxhash64(F.substring(text, start + 1, end - start)))
        return F.filter(F.flatten(F.transform(F.filter(at, heads), of)), both)

    return let(F.struct(joined.alias("t"), ends.alias("e")), lambda x: hashed(x["t"], x["e"]))


def search(lines: DataFrame, keywords: DataFrame, small: int = SMALL) -> DataFrame:
    """A highlight for every match of each keyword (keyword_id, keyword) in the lines (LINES).

    A column `text` of the lines, if there is one, holds the texts of their words, spaces between; lines that can't match are
    then left out before their words are looked at or even placed. Up to `small` needles are broadcast, more are shuffled.
    """
    wanted = needles(keywords).select("keyword_id", "keyword", "needle")
    told = needle_table(wanted)
    if not told.count:
        rows = flattened(lines).limit(0).withColumns({"keyword_id": F.lit(0), "keyword": F.lit(""), "m": F.lit(None).cast("struct<at:int,from:int,to:int>")})
        return _highlights(rows)
    texts = F.split("text", " ", -1) if "text" in lines.columns else F.transform("words", lambda w: F.translate(w["text"], "\n", " "))
    # The filter goes below what places the words; the few lines that are left are hashed again.
    hashes = let(normalized_words(texts), lambda k: F.array_distinct(span_hashes(k, told)))
    hit = lines.filter(F.size(hashes) > 0).withColumn("__hash", F.explode(hashes))
    of = wanted.withColumn("__hash", F.xxhash64("needle"))
    met = flattened(hit.join(F.broadcast(of) if told.count <= small else of, "__hash"))
    return _highlights(met.select("*", F.explode(_matches(F.col("search_text"), F.col("flat"), F.col("needle"))).alias("m")))


def candidate_pages(pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """Complete pages (status, search_text) that may hold a needle; pages without search text are never ruled out."""
    complete = pages.filter("status = 'COMPLETE'")
    some = [r.needle for r in needles(keywords).select("needle").distinct().limit(LITERAL + 1).collect()]
    if not some:
        return complete.limit(0)
    if len(some) <= LITERAL:
        texts = F.array(*map(F.lit, sorted(some)))
        return complete.filter(let(F.col("search_text"), lambda s: (s == "") | F.exists(texts, lambda n: F.contains(s, n))))
    return _by_trigrams(complete, needles(keywords).select("needle").distinct())


def _by_trigrams(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages that hold a needle (wanted: needle) or have no search text.

    Of each needle the trigram that the fewest pages have is looked up, so a common beginning is no hot key. Pages send their
    keys (document_id and, if there is one, page_number) with their trigrams, no texts; what meets is confirmed by contains on the page's own row.
    Shorter needles are tested one by one.
    """
    key = [c for c in ("document_id", "page_number") if c in pages.columns]
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(F.col(c), i, 3)))
    short = [r.needle for r in wanted.filter("length(needle) < 3").collect()]  # of two characters at most, so few
    asked = wanted.filter("length(needle) >= 3").select("needle", F.explode(grams("needle")).alias("gram"))
    held = pages.select(*key, F.explode(grams("search_text")).alias("gram"))
    often = held.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A needle with a trigram that no page has is found nowhere.
    rarest = asked.join(often, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0").select("needle", F.col("r.gram").alias("gram"))
    met = held.join(rarest, "gram").groupBy(*key).agg(F.collect_set("needle").alias("__needles"))
    hit = F.exists(F.coalesce("__needles", F.array().cast("array<string>")), lambda n: F.contains("search_text", n))
    direct = F.exists(F.array(*map(F.lit, short)), lambda n: F.contains("search_text", n)) if short else F.lit(False)
    return pages.join(met, key, "left").filter((F.col("search_text") == "") | hit | direct).select(*pages.columns)


def searched_documents(documents: DataFrame, ids: DataFrame, keywords: DataFrame, highlights: DataFrame) -> DataFrame:
    """document_id, n_highlights of the requested ids (document_id): unknown and pending documents have no row; without a usable keyword every id has one, of 0."""
    if not needles(keywords).limit(1).count():
        return ids.select("document_id", F.lit(0).cast("long").alias("n_highlights"))
    known = ids.join(documents.filter("ocr_status <> 'PENDING'").select("document_id"), "document_id")
    return known.join(highlights.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")), "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("n_highlights"))


def replace_auto(stored: DataFrame, found: DataFrame, ids: DataFrame) -> DataFrame:
    """stored highlights with the automatic ones of the documents in ids replaced by those found; manual ones stay."""
    kept = stored.filter("source = 'MANUAL'").unionByName(stored.filter("source <> 'MANUAL'").join(ids, "document_id", "left_anti"))
    return kept.unionByName(found.join(ids, "document_id", "left_semi"), allowMissingColumns=True)


def replace_all(stored: DataFrame, incoming: DataFrame, ids: DataFrame) -> DataFrame:
    """stored with all highlights of the documents in ids replaced."""
    return stored.join(ids, "document_id", "left_anti").unionByName(incoming.join(ids, "document_id", "left_semi"), allowMissingColumns=True)


def delete_auto(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.filter("source = 'MANUAL'").unionByName(stored.filter("source <> 'MANUAL'").join(ids, "document_id", "left_anti"))


def image_boxes(highlights: DataFrame, width: Column, height: Column) -> DataFrame:
    """highlights with px, py, pw, ph: padded rectangles in an image's pixels, to one decimal."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    dx, dy = w * 0.02, h * 0.18
    one = lambda v: F.round(v, 1)
    return highlights.withColumns({"px": one(F.greatest(F.lit(0.0), x - dx) * width), "py": one(F.greatest(F.lit(0.0), y - dy) * height), "pw": one(F.least(F.lit(1.0), w + dx * 2) * width), "ph": one(F.least(F.lit(1.0), h + dy * 2) * height)})
