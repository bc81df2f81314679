"""The engine's loops as streams: preparing uploads, reading pages, sweeping stopped pages, first lines of transcripts.

Each has a batch twin in folioscope.operators, and gives the same rows over the same input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.functions.text import line_key, trimmed
from folioscope.operators import queue, search
from folioscope.operators.queue import ATTEMPTS, LOST, MESSAGE, PREPARE_BATCH, SPENT, STALE_SECONDS, live_only
from folioscope.sources.shared import shared_path


def upload_stream(spark: SparkSession, path: str, schema: str, batch: int = PREPARE_BATCH) -> DataFrame:
    """New files of a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", batch).parquet(path)


def prepare_loop(uploads: DataFrame, prepare: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True):  # noqa: ANN201
    """Writes prepare(batch) of every batch of uploads; a batch that is run again replaces its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = uploads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def recognition_loop(pages: DataFrame, reader, schema: str, live: DataFrame, out: str, checkpoint: str):  # noqa: ANN001, ANN201
    """Reads pages with a recogniser and appends those that still exist: finished pages can be searched before their document is done."""

    def one(batch: DataFrame, number: int) -> None:
        def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            page = reader()
            names = [c.split()[0] for c in schema.split(", ")]
            for part in parts:
                yield pd.DataFrame([r for row in part.to_dict("records") for r in page(row)], columns=names)

        live_only(batch.mapInPandas(read, schema), live).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _reading(reader, schema: str):  # noqa: ANN001, ANN202
    """A function for mapInPandas from claimed pages to rows of the schema, and the error of those that a reader failed at."""
    names = [c.split()[0] for c in schema.split(", ")]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page = reader()
        for part in parts:
            rows = []
            for row in part.to_dict("records"):
                try:
                    rows.append((*page(row), None))
                except Exception as e:  # whatever a recogniser raises is this page's failure
                    rows.append((row["document_id"], row["page_number"], *[None] * (len(names) - 2), str(e)[:MESSAGE] or type(e).__name__))
            yield pd.DataFrame(rows, columns=[*names, "error"])

    return read


def claiming_loop(ticks: DataFrame, load, save, reader, schema: str, limit: int, worker: str, out: str, checkpoint: str):  # noqa: ANN001, ANN201
    """A reader's loop over the page queue: each batch of ticks (any stream) claims up to `limit` pages, reads them and saves the queue.

    load(number) gives (pages, documents) as they were before that batch, save(pages, number) writes the pages after it in
    place of an earlier try, so a batch that is run again claims the same pages. reader() is called once a task and gives a
    function from a page to its row of the schema; if that raises, the page fails with the message and waits for its next
    attempt, or has none left.
    """
    def one(batch: DataFrame, number: int) -> None:
        pages, documents = load(number)
        where = f"{out}/batch={number}"
        now = F.current_timestamp()
        queue.claim(pages, documents, limit, now, worker).mapInPandas(_reading(reader, schema), f"{schema}, error string").write.mode("overwrite").parquet(where)
        results = batch.sparkSession.read.schema(f"{schema}, error string").parquet(where)
        mine = F.coalesce(F.col("__mine"), F.lit(False))
        held = pages.join(results.select("document_id", "page_number", F.lit(True).alias("__mine")), ["document_id", "page_number"], "left")
        held = held.withColumns({"status": F.when(mine, "PROCESSING").otherwise(F.col("status")), "attempts": F.col("attempts") + mine.cast("int"), "started_at": F.when(mine, now).otherwise(F.col("started_at"))}).drop("__mine")
        failed = results.filter("error IS NOT NULL").select("document_id", "page_number", F.col("error").alias("message"), F.lit(False).alias("permanent"))
        save(queue.fail(queue.complete(held, results.filter("error IS NULL").drop("error")), failed), number)

    return ticks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_claiming_loop(ticks: DataFrame, path: str, schema: str, documents: Callable[[], DataFrame], reader, results: str, limit: int, worker: str, out: str, checkpoint: str):  # noqa: ANN001, ANN201
    """claiming_loop over a stored queue (queue.store, with the schema) of which a batch rewrites only the parts of the documents that it touched.

    A batch puts what it claimed and what became of it in out/batch=..., which is written once: a batch that is run again
    finds it there and saves the same changes, however often the queue was read since. results is the schema of reader()'s rows.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def one(batch: DataFrame, number: int) -> None:
        spark, where = batch.sparkSession, f"{out}/batch={number}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            pages, now = queue.stored(spark, path, schema), F.current_timestamp()
            claimed = queue.claim(pages, documents(), limit, now, worker)
            kept = [c for c in names if c in claimed.columns]
            aside = shared_path(spark, "claims")
            claimed.select(*kept).write.parquet(aside)
            claimed = spark.read.parquet(aside)
            read = claimed.mapInPandas(_reading(reader, results), f"{results}, error string")
            answers = shared_path(spark, "answers")
            read.write.parquet(answers)
            read = spark.read.schema(f"{results}, error string").parquet(answers)
            failed = read.filter("error IS NOT NULL").select("document_id", "page_number", F.col("error").alias("message"), F.lit(False).alias("permanent"))
            after = queue.fail(queue.complete(claimed, read.filter("error IS NULL").drop("error")), failed)
            after.select(*(F.col(c) if c in after.columns else F.lit(None).alias(c) for c in names)).write.mode("overwrite").parquet(where)
        queue.save_changes(spark, path, schema, spark.read.schema(schema).parquet(where))

    return ticks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_loop(lines: DataFrame, keywords: Callable[[], DataFrame], out: str, checkpoint: str):  # noqa: ANN201
    """Highlights of a stream of finished lines (LINES), before their documents are done; keywords() gives the keywords of the time of each batch."""

    def one(batch: DataFrame, number: int) -> None:
        search.search(batch, keywords()).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "status string, attempts int, started_at double, error string"
SWEPT = "document_id long, page_number long, status string, attempts int, error string"


def page_states(events: DataFrame, seconds: float = STALE_SECONDS, clock: bool = True) -> DataFrame:
    """The latest state of each page of a stream of events (document_id, page_number, kind, ts: seconds; message, if there is one).

    Claims spend attempts, releases refund them, and a page that stopped is given back or fails: by the time of its next
    event, or by the clock if none comes within `seconds`. A page that waits without attempts left fails. A complete page is
    forgotten, so the state holds the pages that are still open or failed; an event after that begins anew. A stream with a
    clock always has a next batch, so one that is to end (trigger availableNow) needs clock=False.
    """

    def sweep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, started, error = state.get if state.exists else ("PENDING", 0, float("nan"), None)
        late = lambda: ("FAILED", LOST) if attempts >= ATTEMPTS else ("PENDING", error)
        if state.hasTimedOut:
            status, error = late()
        else:
            for r in pd.concat(list(parts)).sort_values(["ts", "kind"]).itertuples():
                if status == "PROCESSING" and r.ts - started > seconds:
                    status, error = late()
                if r.kind == "claim" and status == "PENDING" and attempts < ATTEMPTS:
                    status, attempts, started = "PROCESSING", attempts + 1, r.ts
                elif r.kind == "complete":
                    status, error = "COMPLETE", None
                elif r.kind == "fail":
                    status, error = "FAILED" if attempts >= ATTEMPTS else "PENDING", getattr(r, "message", None)
                elif r.kind == "release" and status == "PROCESSING":
                    status, attempts = "PENDING", max(0, attempts - 1)
        if status == "PENDING" and attempts >= ATTEMPTS:
            status, error = "FAILED", error or SPENT
        if status == "COMPLETE":
            state.remove()
        else:
            state.update((status, attempts, started, error))
            if clock and status == "PROCESSING":
                state.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame([(*key, status, attempts, error)], columns=[c.split()[0] for c in SWEPT.split(", ")])

    return events.groupBy("document_id", "page_number").applyInPandasWithState(sweep, SWEPT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if clock else GroupStateTimeout.NoTimeout)


def first_lines(turns: DataFrame, at: str | None = None, late: str = "1 day") -> DataFrame:
    """A stream of pages (document_id, page_number, text) as lines, each once a document, but for case and spacing.

    at names a column of the pages' time: what is remembered of a document goes `late` after its lines. Without it every line
    is remembered for as long as the stream runs.
    """
    kept = ["document_id", "page_number"] + [at] * bool(at)
    lines = turns.select(*kept, F.posexplode(F.filter(F.transform(F.split("text", r"\r?\n"), trimmed), lambda x: x != "")).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line")))
    return lines.withWatermark(at, late).dropDuplicatesWithinWatermark(["document_id", "key"]) if at else lines.dropDuplicates(["document_id", "key"])


def queue_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type) by tumbling windows and type, for dashboards of the queue."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
