"""Quality rules with adaptive thresholds, on built-in functions only.

Every text is measured once, and the measures are written as a table. Quantile sketches of each measure are built by language
and source: counts of logarithmic buckets, so quantiles have a relative error of ACCURACY at most. They are combined before the
shuffle, merge by addition into sketches of the language and of the corpus, and come out alike in every run. A group's fences are its quartiles widened by FENCE times their distance and by a measure's slack; a group of fewer than LEAST rows
takes its language's, and a small language the corpus's. The fences are joined to the measures, and a document is kept if
all of its measures lie within them and it didn't fail a base rule.

Nulls: a null text has no words; a null lang or source is a group like others; a null doc_id keeps its row, as do repeated
rows. Texts may be of any length. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import GAP, WORD, checked_broadcast, staged

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
ACCURACY = 0.01
#: Values up to this count as zero.
ZERO = 1e-6
LEAST, FENCE = 100, 3.0
#: measure: (slack, whether low values are held too)
MEASURES = {"symbol_rate": (0.1, False), "dup_line_rate": (0.5, False), "repeat_rate": (0.3, False), "adjacent_rate": (0.2, False), "upper_rate": (0.2, False), "mean_length": (2.0, True)}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_adjacent (words equal to the one before)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)))
    counts = [
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size(F.filter("w", lambda x, i: x == F.get(F.col("w"), i - 1))).cast("long").alias("n_adjacent"),
    ]
    windows = F.when(F.size("w") > WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (WINDOW - 1))), lambda i: F.xxhash64(F.slice("w", i, WINDOW))))
    rows = rows.select("doc_id", "lang", "source", *counts, windows.alias("h"))
    # Hash and place, in order of hashes, where some window occurs twice; places of those; words that they cover.
    rows = rows.withColumn("h", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twin = lambda p, q: F.coalesce(p["x"] == q["x"], F.lit(False))
    rows = rows.withColumn("h", F.filter("h", lambda p, k: twin(p, F.get(F.col("h"), k - 1)) | twin(p, F.get(F.col("h"), k + 1))))
    covered = F.aggregate(F.sort_array(F.transform("h", lambda p: p["i"])), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("h")


def _rates(rows: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return rows.withColumns({
        "symbol_rate": F.col("n_symbols") / words, "repeat_rate": F.col("n_repeat_words") / words, "mean_length": F.col("word_chars") / words, "adjacent_rate": F.col("n_adjacent") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"), "upper_rate": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
    })


def bucket(x: Column) -> Column:
    """The number of a value's bucket; null for zero. A bucket's bounds are powers of (1 + ACCURACY) / (1 - ACCURACY)."""
    return F.when(x > ZERO, F.ceil(F.log(x) / math.log((1 + ACCURACY) / (1 - ACCURACY))).cast("int"))


def _middle(b: Column) -> Column:
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    return F.coalesce(2 * F.pow(F.lit(gamma), b) / (gamma + 1), F.lit(0.0))


def sketches(rates: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): 2000 rows or so a group and measure, at most."""
    every = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES)))
    return rates.select("lang", "source", every.alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, low_<m>, high_<m>): the first and third quartile of each measure, from sketches merged by those columns."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "measure")
    rows = merged.withColumn("all", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(whole.orderBy(F.col("bucket").asc_nulls_first())))
    at = lambda m, q: F.coalesce(F.min(F.when((F.col("measure") == m) & (F.col("upto") >= q * F.col("all")), _middle(F.col("bucket")))), F.lit(0.0))
    return rows.groupBy(*by).agg(F.max("all").alias("n"), *(at(m, q).alias(f"{side}_{m}") for m in MEASURES for side, q in (("low", 0.25), ("high", 0.75))))


def fences(rates: DataFrame) -> DataFrame:
    """lang, source and low_<m>, high_<m> for every measure m. rates: documents with words only."""
    of_group = staged(sketches(rates), "sketches")
    names = [f"{side}_{m}" for m in MEASURES for side in ("low", "high")]
    of_lang = quartiles(of_group, ["lang"]).select(F.col("lang").alias("lang_"), F.struct("n", *names).alias("l"))
    # One row of twelve numbers.
    of_all = quartiles(of_group, []).first()
    rows = quartiles(of_group, ["lang", "source"]).select("lang", "source", F.struct("n", *names).alias("g")).join(of_lang, F.col("lang").eqNullSafe(F.col("lang_")), "left")
    out: list[Column] = []
    for m, (slack, both) in MEASURES.items():
        low, high = (F.when(F.col("g.n") >= LEAST, F.col(f"g.{side}_{m}")).when(F.col("l.n") >= LEAST, F.col(f"l.{side}_{m}")).otherwise(F.lit(of_all[f"{side}_{m}"])) for side in ("low", "high"))
        out.append((high + FENCE * (high - low) + slack).alias(f"high_{m}"))
        out.append((low - FENCE * (high - low) - slack if both else F.lit(float("-inf"))).alias(f"low_{m}"))
    return rows.select("lang", "source", *out)


def judged(docs: DataFrame) -> DataFrame:
    """measured() with base_failed and kept."""
    rows = _rates(staged(measured(docs), "measures"))
    limits = fences(rows.filter("n_words > 0")).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    joined = rows.join(checked_broadcast(limits), F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    within = F.lit(True)
    for m in MEASURES:
        within = within & F.coalesce(F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(True))
    columns = [*docs.select("doc_id", "lang", "source").columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_adjacent"]
    return joined.withColumn("base_failed", failed).select(*columns, "base_failed", (~F.col("base_failed") & within).alias("kept"))
