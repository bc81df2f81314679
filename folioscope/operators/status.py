"""Status, progress, health and exports: roll-ups of pages into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import line_key, trimmed
from folioscope.operators.queue import OUTSTANDING, numbered

STALLED_SECONDS = 120


def document_status(pages: DataFrame) -> DataFrame:
    """document_id, status, page_count, ocr_error from pages (document_id, page_number, status, error): one aggregate, combined before its shuffle."""
    n, failed = F.count(F.lit(1)), F.count_if(F.col("status") == "FAILED")
    first = F.min(F.when(F.col("status") == "FAILED", F.struct("page_number", F.coalesce("error", F.lit("unknown error")).alias("error"))))
    rows = pages.groupBy("document_id").agg(n.alias("n"), F.count_if(F.col("status").isin(*OUTSTANDING)).alias("open"), failed.alias("failed"), F.count_if(F.col("status") == "COMPLETE").alias("complete"), first.alias("first"))
    settled = F.col("open") == 0
    error = F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" page"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(" could not be read (first was page "), F.col("first.page_number").cast("string"), F.lit(": "), F.col("first.error"), F.lit(")."))
    return rows.select("document_id", F.when(~settled, "PROCESSING").when(F.col("complete") > 0, "COMPLETE").otherwise("FAILED").alias("status"), F.when(settled, F.col("n")).alias("page_count"), F.when(settled & (F.col("failed") > 0), F.substring(error, 1, 1000)).alias("ocr_error"))


def stranded(documents: DataFrame, pages: DataFrame, limit: int = 50) -> DataFrame:
    """Prepared documents that aren't settled though none of their pages is outstanding."""
    done = pages.groupBy("document_id").agg(F.count_if(F.col("status").isin(*OUTSTANDING)).alias("open")).filter("open = 0").select("document_id")
    return documents.filter(F.col("prepared_at").isNotNull() & F.col("ocr_status").isin(*OUTSTANDING)).join(done, "document_id", "left_semi").orderBy("upload_seq", "document_id").limit(limit)


def pending_pages(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count_if(F.col("status").isin(*OUTSTANDING)).alias("pending"))


def queue_health(documents: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """One row: what waits, for how long, and whether the queue is stalled."""
    unprepared = F.col("prepared_at").isNull() & F.col("ocr_status").isin(*OUTSTANDING)
    d = documents.agg(F.count_if(unprepared).alias("unprepared_documents"), F.min(F.when(unprepared, F.col("created_at"))).alias("__u"))
    p = pages.agg(F.count_if(F.col("status") == "PENDING").alias("pending_pages"), F.count_if(F.col("status") == "PROCESSING").alias("processing_pages"), F.min(F.when(F.col("status") == "PENDING", F.col("created_at"))).alias("__p"), F.max("started_at").alias("__c"))
    # Both sides are one row.
    row = d.withColumn("__one", F.lit(1)).join(p.withColumn("__one", F.lit(1)), "__one")
    age = lambda c: F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(c).cast("timestamp"))) / 1e6 + 0.5)
    row = row.withColumns({"oldest_unprepared_seconds": age("__u"), "oldest_pending_seconds": age("__p"), "last_claim_seconds": age("__c")})
    oldest = F.greatest(F.coalesce("oldest_pending_seconds", F.lit(0)), F.coalesce("oldest_unprepared_seconds", F.lit(0)))
    stalled = ((F.col("pending_pages") > 0) | (F.col("unprepared_documents") > 0)) & (oldest > STALLED_SECONDS) & (F.col("last_claim_seconds").isNull() | (F.col("last_claim_seconds") > STALLED_SECONDS))
    return row.withColumn("stalled", stalled).drop("__one", "__u", "__p", "__c")


def progress(ids: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """current_page, total_pages, queue_position of the ids (document_id); nulls where there is nothing to report.

    Positions are numbered over the waiting documents only: those without a page.
    """
    of = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("COMPLETE", "FAILED")).alias("done"))
    waiting = documents.filter(F.col("ocr_status").isin(*OUTSTANDING)).join(of.select("document_id"), "document_id", "left_anti")
    waiting = numbered(waiting.select("document_id", "upload_seq"), "queue_position").select("document_id", "queue_position")
    rows = ids.join(of, "document_id", "left").join(waiting, "document_id", "left")
    open_ = F.col("done") < F.col("total")
    waits = F.col("queue_position").isNotNull()
    return rows.select("document_id", F.when(open_, F.col("done")).when(waits, F.lit(0)).alias("current_page"), F.when(open_, F.col("total")).when(waits, F.lit(0)).alias("total_pages"), "queue_position")


def store_stats(documents: DataFrame, pages: DataFrame, highlights: DataFrame) -> DataFrame:
    """name, n: the number of documents, pages and highlights."""
    parts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, x in (("documents", documents), ("pages", pages), ("highlights", highlights))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def statuses(ids: DataFrame, documents: DataFrame, pages: DataFrame, highlights: DataFrame) -> DataFrame:
    """A row for each known id of ids (document_id, position): the document's status, its progress and its highlights."""
    marks = highlights.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_highlights"))
    known = ids.join(documents.select("document_id", "ocr_status"), "document_id")
    now = progress(ids.select("document_id"), documents, pages)
    return known.join(now, "document_id", "left").join(marks, "document_id", "left").withColumn("n_highlights", F.coalesce("n_highlights", F.lit(0)))


def document_detail(documents: DataFrame, pages: DataFrame, highlights: DataFrame) -> DataFrame:
    """documents with their pages and highlights nested, in order."""
    nest = lambda df, name, key: df.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*key, *(c for c in df.columns if c not in ("document_id", *key))))).alias(name))
    return documents.join(nest(pages, "pages", ["page_number"]), "document_id", "left").join(nest(highlights, "highlights", ["page_number"]), "document_id", "left")


def first_lines(pages: DataFrame) -> DataFrame:
    """pages (document_id, page_number, text) with text of only those lines that no earlier one of the document repeats, but for case and spacing."""
    lines = pages.select("document_id", "page_number", F.posexplode(F.filter(F.transform(F.split("text", r"\r?\n"), trimmed), lambda x: x != "")).alias("pos", "line"))
    first = lines.groupBy("document_id", line_key(F.col("line")).alias("key")).agg(F.min(F.struct("page_number", "pos", "line")).alias("f"))
    text = first.groupBy("document_id", F.col("f.page_number").alias("page_number")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f.pos", "f.line"))), lambda x: x["line"]), "\n").alias("__text"))
    return pages.join(text, ["document_id", "page_number"], "left").withColumn("text", F.coalesce("__text", F.lit(""))).drop("__text")


def text_segments(pages: DataFrame, interval: Column | None = None, video: bool = False) -> DataFrame:
    """document_id, page_number, timestamp_s, text of the complete pages; of a video, repeated lines go."""
    done = pages.filter("status = 'COMPLETE'").withColumn("text", trimmed(F.col("text")))
    done = first_lines(done) if video else done
    at = (F.col("page_number") - 1) * interval if interval is not None else F.lit(None).cast("double")
    return done.select("document_id", "page_number", at.alias("timestamp_s"), "text")


def exported_text(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, text (its segments, blank lines between), failed_pages, of the settled documents."""
    texts = segments.groupBy("document_id").agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), lambda t: t != ""), "\n\n").alias("text"))
    state = pages.groupBy("document_id").agg(F.count_if(F.col("status") == "FAILED").alias("failed_pages"), F.count_if(F.col("status").isin(*OUTSTANDING)).alias("open")).filter("open = 0").drop("open")
    return state.join(texts, "document_id", "left").select("document_id", F.coalesce("text", F.lit("")).alias("text"), "failed_pages")


def duration_ms(created: Column, updated: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_micros(updated.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 1000))
