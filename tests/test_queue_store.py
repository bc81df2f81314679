import datetime
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.operators import queue
from folioscope.streaming import loops

SCHEMA = "document_id long, page_number long, status string, attempts int, started_at timestamp, error string, text string"


@pytest.mark.parametrize("kind", ["sparse", "dense", "times", "null", "one"])
def test_places_equal_row_numbers(spark, kind):
    rng = random.Random(kind)
    seq = {"sparse": lambda i: rng.choice([None, rng.randrange(-(2**62), 2**62), 5]), "dense": lambda i: i, "times": lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=rng.randrange(10**15)), "null": lambda i: None, "one": lambda i: 7}[kind]
    rows = [(i, seq(i)) for i in rng.sample(range(10**6), 3000)]
    df = spark.createDataFrame(rows, "document_id long, upload_seq " + ("timestamp" if kind == "times" else "long"))
    got = {r.document_id: r.place for r in queue.numbered(df.repartition(7), "place", rows=100).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}
    ranged = df.withColumn("r", queue._ranges(df, F.struct("upload_seq", "document_id"), 100)).groupBy("r").count().collect()
    assert len(ranged) > 15 and max(r["count"] for r in ranged) < 600  # whatever the numbers are, no range holds a large share
    assert queue.numbered(df.limit(0), "place").collect() == []


def files(path):
    return {str(p.relative_to(path)): hashlib.md5(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet")}


def test_a_change_rewrites_only_the_parts_of_its_documents(spark, tmp_path):
    path = f"{tmp_path}/queue"
    pages = [(d, p, "PENDING", 0, None, None, None) for d in range(200) for p in (1, 2)]
    queue.store(spark.createDataFrame(pages, SCHEMA), path)
    was = files(path)
    changes = [(3, 1, "COMPLETE", 1, None, None, "a"), (77, 2, "FAILED", 3, None, "b", None), (500, 1, "PENDING", 0, None, None, None)]
    for _ in range(2):  # the second time nothing changes any more
        parts = queue.save_changes(spark, path, SCHEMA, spark.createDataFrame(changes, SCHEMA))
    assert 1 <= len(parts) <= 3
    now = files(path)
    stays = {k: v for k, v in was.items() if int(k.split("/")[0].removeprefix("part=")) not in parts}
    assert len(stays) > 40 and stays.items() <= now.items()
    want = {r[:2]: r for r in pages} | {r[:2]: r for r in changes}
    assert sorted(map(tuple, queue.stored(spark, path, SCHEMA).collect())) == sorted(want.values())
    assert queue.save_changes(spark, path, SCHEMA, spark.createDataFrame([], SCHEMA)) == [] and files(path) == now


def test_stored_claiming_loop(spark, tmp_path):
    path = f"{tmp_path}/queue"
    queue.store(spark.createDataFrame([(d, p, "PENDING", 0, None, None, None) for d in (1, 2, 9) for p in (1, 2)], SCHEMA), path)
    documents = spark.createDataFrame([(1, 1, "2024"), (2, 2, "2024"), (9, 3, None)], "document_id long, upload_seq long, prepared_at string")
    spark.range(6).repartition(6).write.parquet(f"{tmp_path}/ticks")

    def reader():
        def page(row):
            if (row["document_id"], row["page_number"]) == (1, 2):
                raise ValueError("no light")
            return row["document_id"], row["page_number"], f"text {row['page_number']}"

        return page

    for _ in range(2):  # ticks that have been seen are not seen again
        ticks = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ticks")
        q = loops.stored_claiming_loop(ticks, path, SCHEMA, lambda: documents, reader, "document_id long, page_number long, text string", 2, "w", f"{tmp_path}/out", f"{tmp_path}/cp")
        q.awaitTermination(240)
    got = {(r.document_id, r.page_number): (r.status, r.attempts, r.text, r.error) for r in queue.stored(spark, path, SCHEMA).collect()}
    assert got == {(1, 1): ("COMPLETE", 1, "text 1", None), (1, 2): ("FAILED", 3, None, "no light"), (2, 1): ("COMPLETE", 1, "text 1", None), (2, 2): ("COMPLETE", 1, "text 2", None), (9, 1): ("PENDING", 0, None, None), (9, 2): ("PENDING", 0, None, None)}
