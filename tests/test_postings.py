import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import postings, search
from folioscope.sources.shared import shared_path

PAGES = "document_id string, page_number int, status string, search_text string, n string"


def keys(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "keyword_id long, keyword string")


def pages_of(rng, documents, letters="abc"):
    return [(f"d{d}", p, rng.choice(["COMPLETE"] * 9 + ["PENDING"]), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 9, 60]))), "x") for d in documents for p in range(1, rng.randint(2, 5))]


def test_index_equals_the_scan_as_pages_come_and_go(spark, monkeypatch):
    monkeypatch.setattr(postings, "GATHERED", 200)  # several rows for a gram of a block
    rng, path = random.Random(4), shared_path(spark, "test-index")
    wanted = keys(spark, "c", "ab", "abc", "abcabc", "bbbbb", "cabac", "xyz", "abx", "--", "", "é日")
    truth = {}
    for run, documents in (("r1", range(40)), ("r2", range(30, 60)), ("r3", [5, 5, 70])):
        rows = pages_of(rng, documents) + ([("é", 1, "COMPLETE", "xé日y", "x"), ("n", 1, "COMPLETE", None, "x"), ("big", 1, "COMPLETE", "b" * (1 << 20) + "xyz" + "c" * 10, "x")] if run == "r2" else [])
        rows = list({r[:2]: r for r in rows}.values())
        df = spark.createDataFrame(rows, PAGES)
        postings.add(df.unionByName(df.limit(3)), path, run)
        truth |= {r[:2]: r[3] for r in rows if r[2] == "COMPLETE" and r[3] is not None}
        got = {tuple(r) for r in postings.candidate_pages(spark, path, wanted).collect()}
        scan = search.candidate_pages(spark.createDataFrame([(*k, "COMPLETE", t, "x") for k, t in truth.items()], PAGES), wanted)
        assert got == {(r.document_id, r.page_number) for r in scan.collect()} and len(got) > 20
        assert got == {tuple(r) for r in postings.candidate_pages(spark, path, wanted, small=0).collect()}
    postings.remove(spark.createDataFrame([("d5",), ("none",)], "document_id string"), path, "r4")
    left = {tuple(r) for r in postings.candidate_pages(spark, path, wanted).collect()}
    assert left == {k for k in got if k[0] != "d5"} and postings.runs(spark, path) == ["r1", "r2", "r3", "r4"]
    assert postings.candidate_pages(spark, path, keys(spark, "--")).collect() == []
    # A run that is complete changes nothing when it comes again.
    postings.add(spark.createDataFrame([("d0", 1, "COMPLETE", "", "x")], PAGES), path, "r1")
    assert {tuple(r) for r in postings.candidate_pages(spark, path, wanted).collect()} == left


def test_a_run_that_dies_is_not_seen_and_may_be_tried_again(spark, monkeypatch):
    path, wanted = shared_path(spark, "test-index"), keys(spark, "abc")
    postings.add(spark.createDataFrame([("a", 1, "COMPLETE", "xabcx", "")], PAGES), path, "r1")
    with monkeypatch.context() as m:
        m.setattr(postings, "_complete", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            postings.add(spark.createDataFrame([("a", 1, "COMPLETE", "none", ""), ("b", 1, "COMPLETE", "abc", "")], PAGES), path, "r2")
    assert [tuple(r) for r in postings.candidate_pages(spark, path, wanted).collect()] == [("a", 1)]
    postings.add(spark.createDataFrame([("a", 1, "COMPLETE", "none", ""), ("c", 1, "COMPLETE", "abc", "")], PAGES), path, "r2")
    assert [tuple(r) for r in postings.candidate_pages(spark, path, wanted).collect()] == [("c", 1)]


def test_empty_index_and_only_wanted_buckets(spark):
    path = shared_path(spark, "test-index")
    assert postings.candidate_pages(spark, path, keys(spark, "abc")).collect() == []
    postings.add(spark.createDataFrame([], PAGES), path, "r0")
    postings.add(spark.createDataFrame([("a", 1, "COMPLETE", "qabcq", "")], PAGES), path, "r1")
    asked = spark.createDataFrame([("abc",)], "gram string")
    read = postings.postings(spark, path, asked)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:400] and "Exchange" not in plan
    assert 0 < read.select("bucket").distinct().count() <= 2
    assert [tuple(r) for r in postings.candidate_pages(spark, path, keys(spark, "ABC")).collect()] == [("a", 1)]
    stored = spark.read.parquet(f"{path}/postings")
    assert stored.filter("gram = 'abc'").select("block", "n", F.col("ordinals")).count() == 1
