"""The test tables as the engine's inputs: pages, lines of positioned words, keywords, queues.

A document is cut into lines of 12 words and pages of 20 lines. Boxes are whole ten-thousandths of the page until the last
step, so that other engines get the same doubles. All of it is one projection of `documents`: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE, PAGE_LINES = 12, 20
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines_of(tokens: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / LINE).cast("int")), lambda g: F.struct(g.alias("g"), F.slice(tokens, g * LINE + 1, LINE).alias("t"), F.coalesce((g % PAGE_LINES != 0) & F.get(tokens, g * LINE - 1).rlike(r"\p{Pd}$"), F.lit(False)).alias("after_dash")))


def token_lines(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """document_id, page_number, line, tokens, after_dash (the line before, on the page, ends with a dash).

    The outer explode keeps the optimizer from testing the array's size first, which would cut each text into words twice.
    """
    docs = docs.select("doc_id", F.regexp_extract_all(F.col("text") if text is None else text, F.lit(WORD), F.lit(0)).alias("tokens"))
    rows = docs.select("doc_id", F.explode_outer(F.when(F.size("tokens") > 0, _lines_of(F.col("tokens")))).alias("l")).filter("l IS NOT NULL")
    return rows.select("doc_id", F.col("doc_id").cast("string").alias("document_id"), (F.floor(F.col("l.g") / PAGE_LINES) + 1).cast("int").alias("page_number"), (F.col("l.g") % PAGE_LINES).alias("line"), F.col("l.t").alias("tokens"), F.col("l.after_dash").alias("after_dash"))


def _words(tokens: Column, page_number: Column, line: Column) -> Column:
    """The tokens of a line with places, confidences and boxes."""

    def word(t: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(tokens, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
        gutter = F.when((i >= 6) & (F.col("doc_id") % 2 == 0), 800).otherwise(0)
        pos = ((page_number - 1) * PAGE_LINES + line) * LINE + i
        return F.struct(
            pos.cast("int").alias("pos"), t.alias("text"), (F.lit(100) - pos % 40).cast("double").alias("confidence"),
            F.least(F.lit(1.0), (before * 15 + i * 50 + gutter) / F.lit(10000.0)).alias("x"),
            ((line * 450 + 400) / F.lit(10000.0)).alias("y"),
            F.least(F.lit(1.0), F.length(t) * 15 / F.lit(10000.0)).alias("width"),
            (F.when(line.isin(0, 10), 300).otherwise(200) / F.lit(10000.0)).alias("height"),
        )

    return F.transform(tokens, word)


def placed(lines: DataFrame) -> DataFrame:
    """token_lines with boxes: schema LINES, and the line's text."""
    return lines.select("document_id", "page_number", "line", _words(F.col("tokens"), F.col("page_number"), F.col("line")).alias("words"), "after_dash", F.array_join("tokens", " ").alias("text"))


def page_slices(docs: DataFrame, tokens: Column) -> DataFrame:
    """doc_id, document_id, page_number, tokens: a row for each page, a slice of the document's words."""
    size = LINE * PAGE_LINES
    docs = docs.select("doc_id", tokens.alias("t"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / size).cast("int")), lambda g: F.slice("t", g * size + 1, size))
    rows = docs.select("doc_id", F.posexplode_outer(F.when(F.size("t") > 0, pages)).alias("g", "tokens")).filter("tokens IS NOT NULL")
    return rows.select("doc_id", F.col("doc_id").cast("string").alias("document_id"), (F.col("g") + 1).alias("page_number"), "tokens")


def placed_pages(docs: DataFrame, tokens: Column) -> DataFrame:
    """document_id, page_number, words: each page's positioned words, line after line, without a shuffle."""
    numbers = F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / LINE).cast("int"))
    words = F.flatten(F.transform(numbers, lambda n: _words(F.slice("tokens", n * LINE + 1, LINE), F.col("page_number"), n)))
    return page_slices(docs, tokens).select("document_id", "page_number", words.alias("words"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(token_lines(table(spark, sf_dir, "documents")))


def damaged_tokens() -> Column:
    """The words of documents with faults put in: broken capitals (ids divisible by 7), split words (11), private-use characters (5)."""
    tokens = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    broken = F.transform(tokens, lambda t, i: F.when((F.col("doc_id") % 7 == 0) & (i % 10 == 0) & (F.length(t) >= 3), F.concat(F.substring(t, 1, 2), F.lit("X"), F.substring(t, F.lit(4), F.length(t)))).otherwise(t))
    split = F.transform(broken, lambda t: F.when(F.col("doc_id") % 11 == 0, F.substring(t, 1, 2)).otherwise(t))
    return F.transform(split, lambda t, i: F.when((F.col("doc_id") % 5 == 0) & (i % 9 == 0), F.concat(t, F.lit("\ue000"))).otherwise(t))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword_id, keyword: the first two words of each benchmark item."""
    tokens = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, 2)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("keyword_id"), F.array_join(tokens, " ").alias("keyword"))


def page_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as pages of a queue: user_id is the document, event_id the page."""
    status = F.when(F.col("event_type") == "click", "PROCESSING").when(F.col("event_type") == "view", "PENDING").when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETE")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("document_id"), F.col("event_id").alias("page_number"), status.alias("status"),
        (F.get_json_object("props", "$.k").cast("int") % 4).alias("attempts"),
        F.when(status.isin("PROCESSING", "COMPLETE"), F.col("ts")).alias("started_at"), F.col("ts").alias("created_at"),
        F.when(status == "FAILED", F.concat(F.lit("code "), F.get_json_object("props", "$.k"))).alias("error"),
    )


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as pages: the order is the document, the return flag its status."""
    status = F.when(F.col("l_returnflag") == "A", "FAILED").when(F.col("l_returnflag") == "N", "COMPLETE").otherwise("PENDING")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), status.alias("status"), F.lit(None).cast("string").alias("error"))
