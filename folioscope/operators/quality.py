"""Whether a page's text can be trusted: ratios of faults, and what follows for pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.encoding import has_legacy_font
from folioscope.functions.text import SPACES, normalize_for_search, readable

# Fixed values.
LEAST_CHARS, LEAST_WORDS, MOST_UNREADABLE = 35, 6, 0.02
BROKEN_PAGE, BROKEN_DOCUMENT, LEAST_TOKENS, LEAST_SUSPECTS = 0.02, 0.5, 40, 3
FRAGMENTED_PAGE, FRAGMENTED_DOCUMENT, FRAGMENT_CHARS = 0.55, 0.25, 3
LEAST_VALID, LEAST_SEARCHABLE, WORD_EDGE = 0.9, 0.65, 1.01
DPI, LEAST_DPI, MOST_PIXELS, DETECTOR_SIDE = 200, 150, 12_000_000, 1600

URL_LIKE = r"(?i)^(https?:|www\.)|\.(az|com|org|net|ru|tr)($|[^0-9A-Za-z_])"
INITIALS = r"^(\p{Lu}\.){1,3}\p{Lu}"
SUSPECT = r"\p{Ll}[A-Z]|\p{L}[0-9]\p{L}"


def unreadable_ratio(texts: Column) -> Column:
    """Unreadable characters of all, for an array of words."""
    total = F.aggregate(texts, F.lit(0), lambda a, t: a + F.length(t))
    left = F.aggregate(texts, F.lit(0), lambda a, t: a + F.length(readable(t)))
    return F.when(total > 0, (total - left) / total).otherwise(0.0)


def broken_ratio(texts: Column) -> Column:
    """Words with a capital or digit inside, of those that are no addresses or initials; 0 below the least counts."""
    judged = F.filter(texts, lambda t: (F.length(t) > 1) & ~t.rlike(URL_LIKE) & ~t.rlike(INITIALS))
    n, bad = F.size(judged), F.size(F.filter(judged, lambda t: t.rlike(SUSPECT)))
    return F.when((n >= LEAST_TOKENS) & (bad >= LEAST_SUSPECTS), bad / n).otherwise(0.0)


def fragmented_ratio(texts: Column) -> Column:
    """Words of three letters and digits or fewer; null below the least count."""
    sizes = F.filter(F.transform(texts, lambda t: F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))), lambda n: n > 0)
    return F.when(F.size(sizes) >= LEAST_TOKENS, F.size(F.filter(sizes, lambda n: n <= FRAGMENT_CHARS)) / F.size(sizes))


def judged_pages(pages: DataFrame, words: str = "words", repaired: str | None = None) -> DataFrame:
    """pages (words: array of structs) with unreadable, broken, fragmented, reason: the first test that the text fails, or null."""
    w = F.col(words)
    pages = pages.withColumn("__t", F.transform(w, lambda x: x["text"]))
    t = F.col("__t")
    pages = pages.withColumns({"unreadable": unreadable_ratio(t), "broken": broken_ratio(t), "fragmented": fragmented_ratio(t), "__c": F.regexp_replace(F.array_join(t, ""), f"[{SPACES}]", "")})
    c, n = F.col("__c"), F.size(w)
    mojibake = F.regexp_count(c, F.lit("[ÃÂÄÅ]."))
    valid = F.size(F.filter(w, lambda x: (F.trim(x["text"]) != "") & (x["x"] >= 0) & (x["y"] >= 0) & (x["width"] > 0) & (x["height"] > 0) & (x["x"] + x["width"] <= WORD_EDGE) & (x["y"] + x["height"] <= WORD_EDGE)))
    searchable = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    tests = [
        ("characters", F.length(c) < LEAST_CHARS),
        ("words", n < LEAST_WORDS),
        ("unreadable", F.col("unreadable") > MOST_UNREADABLE),
        ("legacy font", ~(F.col(repaired) if repaired else F.lit(False)) & has_legacy_font(c)),
        ("broken encoding", F.col("broken") > BROKEN_PAGE),
        ("fragmented", F.coalesce("fragmented", F.lit(0.0)) > FRAGMENTED_PAGE),
        ("mojibake", (mojibake >= 2) & (mojibake * 2 >= F.length(c) * 0.08)),
        ("geometry", valid / n < LEAST_VALID),
        ("searchable", searchable / F.length(c) < LEAST_SEARCHABLE),
    ]
    return pages.withColumn("reason", F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in tests))).drop("__t", "__c")


def prepared_pages(judged: DataFrame, mode: Column) -> DataFrame:
    """judged pages as they are stored: text and words only where the text layer is used."""
    used = F.col("reason").isNull() & (F.upper(mode) != "FORCE_OCR")
    text = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    return judged.withColumns({"source": F.when(used, "pdf-text").otherwise("pending"), "status": F.when(used, "COMPLETE").otherwise("PENDING"), "text": F.when(used, text).otherwise(""), "search_text": F.when(used, normalize_for_search(text)).otherwise(""), "words": F.when(used, F.col("words")).otherwise(F.slice("words", 1, 0))})


def swept(pages: DataFrame) -> DataFrame:
    """pages (source, status, broken, fragmented) after the sweeps of their documents: requeue is "encoding", "fragments" or null.

    Half of a document's pages broken: its text pages with any broken word go back; then a quarter of the pages that could
    be judged fragmented: all of its text pages do. Shares are over window aggregates of one shuffle by document.
    """
    doc = Window.partitionBy("document_id")
    encoding = F.count_if(F.col("broken") > BROKEN_PAGE).over(doc) / F.count(F.lit(1)).over(doc) >= BROKEN_DOCUMENT
    fragments = F.count_if(F.col("fragmented") > FRAGMENTED_PAGE).over(doc) / F.nullif(F.count("fragmented").over(doc), F.lit(0)) >= FRAGMENTED_DOCUMENT
    pages = pages.withColumns({"__e": encoding, "__f": F.coalesce(fragments, F.lit(False))})
    text = F.col("source") == "pdf-text"
    return pages.withColumn("requeue", F.when(text & F.col("__e") & (F.col("broken") > 0), "encoding").when(text & F.col("__f"), "fragments")).drop("__e", "__f")


def requeued(pages: DataFrame) -> DataFrame:
    """swept pages with those to be requeued blanked."""
    again = F.col("requeue").isNotNull()
    columns = {"status": F.when(again, "PENDING").otherwise(F.col("status")), "source": F.when(again, "pending").otherwise(F.col("source"))}
    for c in ("text", "search_text"):
        if c in pages.columns:
            columns[c] = F.when(again, "").otherwise(F.col(c))
    if "words" in pages.columns:
        columns["words"] = F.when(again, F.slice("words", 1, 0)).otherwise(F.col("words"))
    return pages.withColumns(columns)


def render_dpi(width: Column, height: Column, dpi: int = DPI, least: int = LEAST_DPI, pixels: int = MOST_PIXELS) -> Column:
    """Dots an inch for a page in points, so that it stays within the pixels but not under the least."""
    area = (width / 72) * (height / 72)
    fit = F.floor(F.sqrt(F.lit(float(pixels)) / area))
    return F.when(area > 0, F.greatest(F.lit(least), F.least(F.lit(dpi), fit))).otherwise(F.lit(dpi)).cast("int")


def detector_side(width: Column, height: Column, most: int = DETECTOR_SIDE) -> Column:
    return F.least(F.lit(most), F.greatest(width, height)).cast("int")
