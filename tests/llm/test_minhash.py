import hashlib
import random
import re

from pyspark.sql import functions as F

from folioscope.llm import minhash
from folioscope.llm.queries import op5_minhash_fingerprints


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_edits_and_estimates(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 5, 12, 40, 200, 900]))) for _ in range(300)]
    texts += ["", None, " \n", "é😀ü x", texts[0], "one", "one", "z " * 30_000]
    rows = [(7 * i - 100, t, "x", 1) for i, t in enumerate(texts)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    spark.createDataFrame(shuffled, "doc_id long, text string, signature string, edited int").write.parquet(f"{tmp_path}/documents.parquet")
    minhash.RANGE_ROWS, was = 20, minhash.RANGE_ROWS
    try:
        got = {r.doc_id: r for r in op5_minhash_fingerprints(spark, str(tmp_path)).collect()}
    finally:
        minhash.RANGE_ROWS = was
    off = []
    for i, (key, text, *_) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r = got[key]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert len(r.fingerprint) == (512 if shingles(text) else 0)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        off += [r.near_edited - jaccard(text, new), r.near_next - jaccard(text, after)]
    assert len(got) == len(rows)
    assert abs(sum(off) / len(off)) < 0.01 and max(map(abs, off)) < 0.17
    assert got[rows[0][0]].fingerprint == got[rows[304][0]].fingerprint


def test_densification_is_unbiased_on_short_texts(spark):
    rng = random.Random(4)
    pairs = []
    for i in range(300):
        words = [f"v{rng.randrange(10**6)}" for _ in range(24)]
        pairs.append((i, " ".join(words), " ".join(words[:16] + [f"u{rng.randrange(10**6)}" for _ in range(8)])))
    df = spark.createDataFrame(pairs, "i long, a string, b string")
    df = minhash.with_signature(minhash.with_signature(df, "a", "sa"), "b", "sb")
    mean = df.agg(F.avg(minhash.likeness(F.col("sa"), F.col("sb")))).first()[0]
    assert abs(mean - 12 / 28) < 0.03


def test_nulls_ties_single_and_empty(spark):
    def run(rows):
        return [(r.doc_id, r.text, r.edited) for r in minhash.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()]

    assert run([(5, "abcd")]) == [(5, "abcd", "abab")]
    assert sorted(run([(None, "ab"), (1, "cd"), (1, "xy"), (1, "xy")]), key=str) == sorted([(None, "ab", "ac"), (1, "cd", "cx"), (1, "xy", "xx"), (1, "xy", "xa")], key=str)
    assert run([]) == []


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = op5_minhash_fingerprints(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_next_of_one_hot_id_and_of_many_ranges(spark):
    """100 000 rows, most under one id: ranges stay small, and each row has its next in one global order."""
    from pyspark.sql import Window

    rows = spark.range(100_000).select(F.when(F.col("id") < 60_000, F.lit(77)).when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    minhash.RANGE_ROWS, was = 500, minhash.RANGE_ROWS
    try:
        ranged = minhash._ranged(rows.withColumn("__order", F.coalesce("doc_id", F.lit(-(1 << 63)))))
        assert ranged.groupBy("__range").count().agg(F.max("count")).first()[0] < 2000
        got = minhash.with_next(rows, ["text"])
        assert got.columns == ["doc_id", "text", "next_text"]
        many = F.coalesce(F.col("doc_id"), F.lit(77)) == 77
        h = F.when(many, F.xxhash64("text")).otherwise(0)
        order = Window.orderBy(F.col("doc_id").asc_nulls_first(), F.shiftrightunsigned(h, 1), h, "text")
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        want = rows.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.first("text").over(whole)))
        assert got.count() == 100_000 and got.exceptAll(want).isEmpty()
    finally:
        minhash.RANGE_ROWS = was
