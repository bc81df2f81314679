"""The page queue as pure functions of its state: pages and documents in, pages and documents out; the caller writes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.sources.shared import shared_path

# Fixed values.
ATTEMPTS, STALE_SECONDS, PREPARE_BATCH, RETAINED, MESSAGE = 3, 600, 10, 200, 1000
LOST = "The reader for this page stopped before it finished, and no attempts were left."
SPENT = "This page ran out of attempts."
OUTSTANDING = ("PENDING", "PROCESSING")
#: Documents that are numbered in one task, about, and those of each that tell the ranges.
RANGE_ROWS, TELLING = 1 << 20, 32
#: Parts of a stored queue; each has whole documents.
PARTS = 64


def _ranges(documents: DataFrame, key: Column, rows: int) -> Column:
    """The range, from 0, that a row's key lies in. Bounds are keys of rows that a hash of the key chooses, so any two runs agree.

    Bounds are compared in two steps, some of every so many first, so a row is compared with twice the root of their number.
    """
    n = -(-documents.count() // rows)
    if n <= 1:
        return F.lit(0)
    chosen = F.pmod(F.xxhash64(key), F.lit(rows)) < TELLING
    sample = documents.filter(chosen).select(key.alias("k")).distinct().sort("k").collect()  # TELLING a range, about
    bounds = [r.k for r in sample[TELLING - 1 :: TELLING]] if len(sample) > TELLING else [r.k for r in sample]
    if not bounds:
        return F.lit(0)
    kinds = documents.select(key.alias("k")).schema["k"].dataType
    value = lambda k: F.struct(*(F.lit(k[f.name]).cast(f.dataType).alias(f.name) for f in kinds.fields))
    step = math.isqrt(len(bounds) - 1) + 1
    fine = F.array(*(F.array(*map(value, bounds[i : i + step])) for i in range(0, len(bounds), step)))
    coarse = F.array(*map(value, bounds[::step]))
    at = F.size(F.filter(coarse, lambda b: b <= key))
    return F.when(at == 0, 0).otherwise((at - 1) * step + F.size(F.filter(F.get(fine, at - 1), lambda b: b <= key)))


def numbered(documents: DataFrame, name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """documents with their place, from 1, in the order of upload_seq (null first) and document_id.

    Ranges of about `rows` documents each are numbered apart, after the documents of lower ranges, whatever the upload numbers
    are: sparse, repeated, time stamps or null. The only window over everything is over one row a range.
    """
    key = F.struct("upload_seq", "document_id")
    ranged = documents.withColumn("__range", _ranges(documents, key, rows))
    lower = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy("upload_seq", "document_id"))
    return ranged.withColumn("__own", own).join(before, "__range").withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__before", "__own")


def part_of(document_id: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(document_id.cast("string")), F.lit(parts)).cast("int")


def store(pages: DataFrame, path: str) -> None:
    """pages as a stored queue: Parquet cut by a hash of the document."""
    cut = pages.withColumn("part", part_of(F.col("document_id")))
    cut.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, part int").parquet(path).drop("part")


def save_changes(spark: SparkSession, path: str, schema: str, changes: DataFrame) -> list[int]:
    """Writes pages that changed (whole rows of the schema) into a stored queue and gives the parts that were written anew.

    Only those parts are read and replaced, each as a whole; a page that isn't stored yet is added. The rows are put aside first,
    in the shared folder, so what is read is not what is replaced, and a try that is run again writes the same.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    mine = changes.select(*columns).withColumn("part", part_of(F.col("document_id")))
    parts = sorted(r.part for r in mine.select("part").distinct().collect())  # PARTS at most
    if not parts:
        return parts
    old = spark.read.schema(f"{schema}, part int").parquet(path).filter(F.col("part").isin(parts))
    new = old.join(mine.select("document_id", "page_number"), ["document_id", "page_number"], "left_anti").select(*columns, "part").unionByName(mine)
    aside = shared_path(spark, "queue")
    new.write.parquet(aside)
    spark.read.schema(new.schema).parquet(aside).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return parts


def claimable(pages: DataFrame, documents: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """Pending pages with attempts left, of prepared documents, with the documents' upload_seq."""
    ready = documents.filter("prepared_at IS NOT NULL").select("document_id", "upload_seq")
    return pages.filter((F.col("status") == "PENDING") & (F.col("attempts") < attempts)).join(ready, "document_id")


def claim(pages: DataFrame, documents: DataFrame, limit: int, now: Column, worker: str, attempts: int = ATTEMPTS) -> DataFrame:
    """The first `limit` claimable pages, by upload and page, as they are once claimed: a top-k, not a full sort."""
    top = claimable(pages, documents, attempts).orderBy("upload_seq", "document_id", "page_number").limit(limit)
    return top.withColumns({"status": F.lit("PROCESSING"), "attempts": F.col("attempts") + 1, "locked_by": F.lit(worker), "started_at": now})


def release_stale(pages: DataFrame, now: Column, seconds: int = STALE_SECONDS, attempts: int = ATTEMPTS) -> DataFrame:
    """pages with those that stopped, or have no attempts left, released or failed; changed says which."""
    stale = F.coalesce((F.col("status") == "PROCESSING") & (F.col("started_at") < now - F.make_interval(secs=F.lit(seconds))), F.lit(False))
    spent = F.col("attempts") >= attempts
    given_up = stale & spent
    idle = (F.col("status") == "PENDING") & spent
    changed = stale | idle
    return pages.withColumns({
        "status": F.when(given_up | idle, "FAILED").when(stale, "PENDING").otherwise(F.col("status")),
        "error": F.when(given_up, LOST).when(idle, SPENT).otherwise(F.col("error")),
        "started_at": F.when(changed, F.lit(None)).otherwise(F.col("started_at")),
        "changed": changed,
    })


def fail(pages: DataFrame, failures: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """pages after failures (document_id, page_number, message, permanent): a permanent one has no attempts left."""
    f = failures.select("document_id", "page_number", F.substring("message", 1, MESSAGE).alias("__message"), F.coalesce("permanent", F.lit(False)).alias("__permanent"), F.lit(True).alias("__failed"))
    joined = pages.join(f, ["document_id", "page_number"], "left")
    spent = F.col("__permanent") | (F.col("attempts") >= attempts)
    return joined.withColumns({
        "status": F.when(F.col("__failed"), F.when(spent, "FAILED").otherwise("PENDING")).otherwise(F.col("status")),
        "error": F.when(F.col("__failed"), F.col("__message")).otherwise(F.col("error")),
        "started_at": F.when(F.col("__failed"), F.lit(None)).otherwise(F.col("started_at")),
    }).drop("__message", "__permanent", "__failed")


def complete(pages: DataFrame, done: DataFrame) -> DataFrame:
    """pages after done (document_id, page_number, text, ...): its columns are taken, and results for unknown pages ignored."""
    new = [c for c in done.columns if c not in ("document_id", "page_number")]
    d = done.select("document_id", "page_number", *(F.col(c).alias(f"__{c}") for c in new), F.lit(True).alias("__done"))
    joined = pages.join(d, ["document_id", "page_number"], "left")
    columns = {c: F.when(F.col("__done"), F.col(f"__{c}")).otherwise(F.col(c) if c in pages.columns else F.lit(None)) for c in new}
    columns |= {"status": F.when(F.col("__done"), "COMPLETE").otherwise(F.col("status")), "error": F.when(~F.coalesce("__done", F.lit(False)), F.col("error")), "started_at": F.when(~F.coalesce("__done", F.lit(False)), F.col("started_at"))}
    return joined.withColumns(columns).drop("__done", *(f"__{c}" for c in new))


def release(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """pages with those of ids (document_id, page_number) that are processing given back, and the attempt refunded."""
    joined = pages.join(ids.select("document_id", "page_number", F.lit(True).alias("__back")).distinct(), ["document_id", "page_number"], "left")
    back = F.coalesce(F.col("__back"), F.lit(False)) & (F.col("status") == "PROCESSING")
    return joined.withColumns({"attempts": F.when(back, F.greatest(F.lit(0), F.col("attempts") - 1)).otherwise(F.col("attempts")), "started_at": F.when(back, F.lit(None)).otherwise(F.col("started_at")), "status": F.when(back, "PENDING").otherwise(F.col("status"))}).drop("__back")


def to_prepare(documents: DataFrame, now: Column, seconds: int = STALE_SECONDS, limit: int = PREPARE_BATCH) -> DataFrame:
    """The first documents that nobody has prepared, or whose preparation stopped."""
    waiting = (F.col("ocr_status") == "PENDING") | ((F.col("ocr_status") == "PROCESSING") & (F.col("updated_at") < now - F.make_interval(secs=F.lit(seconds))))
    return documents.filter(F.col("prepared_at").isNull() & waiting).orderBy("upload_seq", "document_id").limit(limit)


def append_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    return pages.unionByName(new.withColumn("attempts", F.lit(0)), allowMissingColumns=True)


def delete_pages(pages: DataFrame, ids: DataFrame) -> DataFrame:
    return pages.join(ids, "document_id", "left_anti")


def replace_pages(pages: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    return append_pages(delete_pages(pages, ids), new.join(ids, "document_id", "left_semi"))


def requeue_documents(documents: DataFrame, ids: DataFrame, mode: str) -> DataFrame:
    """documents with those of ids back at the start (their pages and automatic highlights are to be deleted)."""
    again = F.coalesce(F.col("__again"), F.lit(False))
    joined = documents.join(ids.select("document_id", F.lit(True).alias("__again")).distinct(), "document_id", "left")
    columns = {"ocr_status": F.when(again, "PENDING").otherwise(F.col("ocr_status")), "ocr_mode": F.when(again, mode).otherwise(F.col("ocr_mode"))}
    for c in ("ocr_error", "page_count", "prepared_at"):
        if c in documents.columns:
            columns[c] = F.when(~again, F.col(c))
    return joined.withColumns(columns).drop("__again")


def delete_documents(documents: DataFrame, pages: DataFrame, highlights: DataFrame, ids: DataFrame) -> tuple[DataFrame, ...]:
    """(documents, pages, highlights, removed documents); unknown ids are ignored."""
    return (*(x.join(ids, "document_id", "left_anti") for x in (documents, pages, highlights)), documents.join(ids, "document_id", "left_semi"))


def overflow(documents: DataFrame, pages: DataFrame, retained: int = RETAINED) -> DataFrame:
    """The oldest settled documents, without a page at work, that exceed the number retained.

    The count is one small action. Places are numbered by ranges, so nothing passes through one task however many go.
    """
    over = max(0, documents.count() - retained)
    busy = pages.filter("status = 'PROCESSING'").select("document_id").distinct()
    settled = documents.filter(F.col("ocr_status").isin("COMPLETE", "FAILED")).join(busy, "document_id", "left_anti")
    return numbered(settled, "__place").filter(F.col("__place") <= over).drop("__place")


def live_only(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Results for pages that still exist."""
    return results.join(pages.select("document_id", "page_number"), ["document_id", "page_number"], "left_semi")


