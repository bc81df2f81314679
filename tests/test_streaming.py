import time

from pyspark.sql import functions as F

from folioscope.operators import search, status
from folioscope.streaming import loops


def test_prepare_loop_equals_batch(spark, tmp_path):
    rows = [(i, f"name {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, name string")
    df.repartition(25).write.parquet(f"{tmp_path}/in")
    prepare = lambda d: d.select("id", F.upper("name").alias("name"))
    q = loops.prepare_loop(loops.upload_stream(spark, f"{tmp_path}/in", "id long, name string"), prepare, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("id", "name").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, prepare(df).collect()))
    assert len(spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().collect()) >= 2


def test_recognition_ignores_deleted_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "document_id long, page_number long")
    pages.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(pages.schema).parquet(f"{tmp_path}/in")

    def reader():
        return lambda page: [(page["document_id"], page["page_number"], f"text {page['page_number']}")]

    q = loops.recognition_loop(stream, reader, "document_id long, page_number long, text string", pages.filter("document_id = 1"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert {(r.document_id, r.page_number) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 1), (1, 2)}


def test_first_lines_equal_batch(spark, tmp_path):
    rows = [(1, 1, "a\nb"), (1, 2, "B \nc"), (2, 1, "a  x\na x")]
    df = spark.createDataFrame(rows, "document_id long, page_number long, text string")
    df.coalesce(1).sortWithinPartitions("document_id", "page_number").write.parquet(f"{tmp_path}/in")
    q = loops.first_lines(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("first_lines").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    got = {(r.document_id, r.key) for r in spark.sql("select * from first_lines").collect()}
    batch = {(r.document_id, x.lower()) for r in status.first_lines(df).collect() for x in r.text.split("\n") if x}
    assert got == {(d, " ".join(x.split())) for d, x in batch}


def test_page_states(spark, tmp_path):
    events = [(1, 1, "claim", 0.0), (1, 1, "complete", 5.0), (1, 2, "claim", 0.0), (1, 2, "release", 1.0), (1, 3, "claim", 0.0), (1, 3, "claim", 1000.0), (1, 3, "claim", 2000.0), (1, 3, "claim", 3000.0), (1, 4, "claim", 0.0), (1, 4, "fail", 1.0)]
    df = spark.createDataFrame(events, "document_id long, page_number long, kind string, ts double")
    df.write.parquet(f"{tmp_path}/in")
    q = loops.page_states(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), clock=False).writeStream.format("memory").queryName("page_states").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(180)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 3  # the complete page is forgotten
    got = {r.page_number: (r.status, r.attempts) for r in spark.sql("select * from page_states").collect()}
    assert got == {1: ("COMPLETE", 1), 2: ("PENDING", 0), 3: ("FAILED", 3), 4: ("PENDING", 1)}


def test_silent_pages_are_swept_by_the_clock(spark, tmp_path):
    events = [(1, 1, "claim", 0.0), (1, 2, "claim", 0.0), (1, 2, "complete", 1.0), (1, 3, "claim", 0.0), (1, 3, "fail", 1.0), (1, 3, "claim", 2.0), (1, 3, "fail", 3.0), (1, 3, "claim", 4.0)]
    df = spark.createDataFrame([(*e, "broken" if e[2] == "fail" else None) for e in events], "document_id long, page_number long, kind string, ts double, message string")
    df.write.parquet(f"{tmp_path}/in")
    seen = {}

    def take(batch, number):
        seen.update({r.page_number: (r.status, r.attempts, r.error) for r in batch.collect()})

    states = loops.page_states(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), seconds=5)
    q = states.writeStream.foreachBatch(take).outputMode("update").trigger(processingTime="1 second").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        end = time.time() + 120
        while time.time() < end and (len(seen) < 3 or any(s[0] == "PROCESSING" for s in seen.values())) and q.isActive:
            time.sleep(0.5)
    finally:
        q.stop()
    assert seen == {1: ("PENDING", 1, None), 2: ("COMPLETE", 1, None), 3: ("FAILED", 3, "The reader for this page stopped before it finished, and no attempts were left.")}


def test_claiming_loop(spark, tmp_path):
    pages = spark.createDataFrame([(d, p, "PENDING", 0, None, None) for d in (1, 2, 9) for p in (1, 2)], "document_id long, page_number long, status string, attempts int, started_at timestamp, error string")
    documents = spark.createDataFrame([(1, 1, "2024"), (2, 2, "2024"), (9, 3, None)], "document_id long, upload_seq long, prepared_at string")
    pages.write.parquet(f"{tmp_path}/state/-1")
    spark.range(8).repartition(8).write.parquet(f"{tmp_path}/ticks")

    def load(number):
        return spark.read.parquet(f"{tmp_path}/state/{number - 1}"), documents

    def save(state, number):
        state.write.mode("overwrite").parquet(f"{tmp_path}/state/{number}")

    def reader():
        def page(row):
            if (row["document_id"], row["page_number"]) == (1, 2):
                raise ValueError("no light")
            return row["document_id"], row["page_number"], f"text {row['page_number']}"

        return page

    ticks = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ticks")
    q = loops.claiming_loop(ticks, load, save, reader, "document_id long, page_number long, text string", 2, "w", f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(240)
    last = max(int(p.name) for p in (tmp_path / "state").iterdir())
    assert last >= 3
    first = {(r.document_id, r.page_number): (r.status, r.attempts) for r in spark.read.parquet(f"{tmp_path}/state/0").collect()}
    assert first == {(1, 1): ("COMPLETE", 1), (1, 2): ("PENDING", 1), (2, 1): ("PENDING", 0), (2, 2): ("PENDING", 0), (9, 1): ("PENDING", 0), (9, 2): ("PENDING", 0)}
    got = {(r.document_id, r.page_number): (r.status, r.attempts, r.text, r.error) for r in spark.read.parquet(f"{tmp_path}/state/{last}").collect()}
    assert got == {(1, 1): ("COMPLETE", 1, "text 1", None), (1, 2): ("FAILED", 3, None, "no light"), (2, 1): ("COMPLETE", 1, "text 1", None), (2, 2): ("COMPLETE", 1, "text 2", None), (9, 1): ("PENDING", 0, None, None), (9, 2): ("PENDING", 0, None, None)}


def test_search_loop_equals_batch(spark, tmp_path):
    words = "array<struct<pos:int,text:string,confidence:double,x:double,y:double,width:double,height:double>>"
    rows = [(str(d), 1, n, [(i, t, 90.0, i * 0.1, 0.1, 0.05, 0.02) for i, t in enumerate(["one", "Bank", "of", "two"])], False) for d in range(6) for n in range(3)]
    df = spark.createDataFrame(rows, f"document_id string, page_number int, line int, words {words}, after_dash boolean")
    df.repartition(6).write.parquet(f"{tmp_path}/in")
    keywords = spark.createDataFrame([(1, "bank"), (2, "of two"), (3, "none")], "keyword_id int, keyword string")
    for wanted in (keywords, keywords.union(spark.range(300).select(F.col("id").cast("int") + 10, F.concat(F.lit("zz"), "id")))):
        run = tmp_path / str(wanted.count())
        q = loops.search_loop(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in"), lambda w=wanted: w, f"{run}/out", f"{run}/cp")
        q.awaitTermination(240)
        columns = ["document_id", "line", "keyword_id", "start_at", "n_words"]
        got = spark.read.parquet(f"{run}/out").select(*columns).collect()
        assert len(got) == 36 and sorted(got) == sorted(search.search(df, keywords).select(*columns).collect())


def test_first_lines_are_forgotten(spark, tmp_path):
    rows = [(1, 1, "a\nb", "2024-01-01 00:00:00"), (1, 2, "B \nc", "2024-01-01 00:00:10"), (2, 1, "a  x\na x", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "document_id long, page_number long, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = loops.first_lines(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), at="ts").writeStream.format("memory").queryName("first_lines_late").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    assert sorted((r.document_id, r.key) for r in spark.sql("select * from first_lines_late").collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "a x")]
