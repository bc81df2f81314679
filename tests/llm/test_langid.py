import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import langid, queries
from folioscope.llm.mil import held_out

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["ção", "lh", "nh", "que"]}


def text(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, lang, rng.randint(1, 60)), lang) for i, lang in enumerate(rng.choice(["aa", "aa", "aa", "bb", "cc"]) for _ in range(600))]
    rows += [(None, "kalo mitu", "aa"), (9001, None, "bb"), (9002, "no language", None), (9003, "123 !", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return langid.trained(docs), docs


def test_learns_and_predicts_short_and_long_texts(spark, model):
    model, _ = model
    rng = random.Random(6)
    rows = [(i, text(rng, lang, n), lang) for i, (lang, n) in enumerate((lang, n) for lang in SYLLABLES for n in (2, 5, 30, 300) for _ in range(20))]
    got = langid.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    assert model.languages == ["aa", "bb", "cc"]
    # What is accepted is right about as often as promised.
    accepted = [r for r in got if r.accepted]
    assert len(accepted) > 0.8 * len(got) and sum(r.lang == r.lang_pred for r in accepted) >= 0.97 * len(accepted)


def test_edges(spark, model):
    model, _ = model
    long = "kalomi " * 300_000 + "ka" * 200_000
    rows = [(1, None, "x", 5), (2, "", "x", 5), (3, "12 ½ -- ́ _", "x", 5), (None, "schung verein", "x", 5), (4, long, "x", 5), (4, long, "x", 5), (5, "²a", "x", 5), (6, "日本語 ", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, Score int")
    out = langid.predicted(docs, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "accepted"]
    got = sorted(out.collect(), key=lambda r: (r.doc_id or 0, r.text or ""))
    assert [(r.doc_id, r.lang_pred) for r in got if r.doc_id in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")]
    assert all(r.score == 0 and not r.accepted for r in got if r.lang_pred == "und")
    assert next(r.lang_pred for r in got if r.doc_id is None) == "bb" and {(r.lang_pred, r.score) for r in got if r.doc_id == 4} == {("aa", got[-3].score)}
    assert all(r.lang_pred in SYLLABLES for r in got if r.doc_id in (5, 6))
    assert langid.predicted(docs.limit(0), model).collect() == []
    assert {r.lang_pred for r in langid.predicted(docs, None).collect()} == {"und"}


def test_the_sample_is_bounded_and_not_held_out(spark, model):
    _, docs = model
    rows = langid.training_bags(docs.union(docs.filter("doc_id < 50")), most=30)
    of = {}
    for r in rows:
        of.setdefault(r.lang, set()).add(r.h)
        assert len(r.buckets) <= 2 * langid.BUCKETS and 2 * len(r.buckets) == len(r.counts)
    assert set(of) == {"aa", "bb", "cc"} and all(len(x) <= 10 for x in of.values())
    outside = {r.h for r in docs.filter(held_out(F.col("doc_id"))).select(F.xxhash64("doc_id").alias("h")).collect()}
    assert not outside & set().union(*of.values())
    assert [tuple(r) for r in rows] == [tuple(r) for r in langid.training_bags(docs.repartition(5), most=30)]  # repeated rows, other partitions
    assert langid.training_bags(docs, languages=1) and {r.lang for r in langid.training_bags(docs, languages=1)} == {"aa"}
    assert langid.trained(docs.limit(0)) is None and langid.trained(docs.withColumn("lang", F.lit(None))) is None


def by_hand(text):
    """The number of features of a text: of each run of letters one, and the 2- to 4-grams of it between two marks."""
    total = 0
    for run in "".join(c if c.isalpha() else " " for c in text).split(" "):
        total += 1 + sum(max(0, len(run) + 2 - n + 1) for n in (2, 3, 4)) if run else 0
    return total


def test_bags(model):
    """Counts by hand; texts don't touch each other; case, order of runs and what stands between them don't matter."""
    texts = ["", "a", "Ab-cd", "x1y  z", "été ÉTÉ", "日本 語", "\0a\0", "ß İ ǅ", "abcdefgh ijkl"]
    got = langid.bags(texts)
    assert got.sum(1).tolist() == [by_hand(t) for t in texts]
    assert all((langid.bags([t])[0] == got[i]).all() for i, t in enumerate(texts))
    assert (langid.bags(["cd, AB"])[0] == got[2]).all() and (got[4] % 2 == 0).all() and (got[6] == got[1]).all()
    assert (langid.bags(["ba dc"])[0] != got[2]).any()
    rng = random.Random(7)
    t = text(rng, "bb", 300_000)
    assert len(t) > 2 << 20 and (langid.bag(t.encode()) == langid.bags([t])[0]).all()


def test_gradient_step_lowers_the_loss(model):
    model, docs = model
    sample = [(np.array([1, 2]), np.array([1.0, 2.0])), (np.array([3]), np.array([1.0]))] * 20
    of = np.array([0, 1] * 20)
    x = np.zeros((40, langid.BUCKETS))
    for i, (b, c) in enumerate(sample):
        x[i, b] = c
    few = langid.descended(sample, of, ["a", "b"], epochs=1).logits(x)
    more = langid.descended(sample, of, ["a", "b"], epochs=60).logits(x)
    loss = lambda z: -np.log(langid._softmax(z)[np.arange(40), of]).mean()
    assert loss(more) < 0.2 < loss(few)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables aren't here")
def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op12_language_id(spark, path).collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(out) > 150
    assert sum(truth[r.doc_id] == r.lang_pred for r in out) >= 0.98 * len(out)
