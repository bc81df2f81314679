import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import mil
from folioscope.llm.queries import op3_mil_quality


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(2000)]
    rows, quality = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(10, 400))
        good = rng.random() < 0.8
        if not good:
            kind = i % 3
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + rng.choice(["%%%", "***"]) for w in words] if kind == 1 else [w for w in words for _ in range(6)]
        rows.append((i, " ".join(words)))
        quality.append((i, int(good), 0))
    return rows, quality


def test_held_out_accuracy_and_contract(spark, tmp_path):
    rows, quality = corpus(900)
    rows += [(None, "good plain words here"), (5000, None), (5001, ""), (5002, "word " * 300_000), (3, rows[3][1])]
    quality += [(None, 0, 0), (7, None, 0), (99999, 1, 0), (8, quality[8][1], 0)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(quality, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op3_mil_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    of = {i: q for i, q, _ in quality[:900]}
    out = [(r.predicted, of[r.doc_id]) for r in got if r.held_out and r.doc_id in of]
    assert len(out) > 150 and sum(p == q for p, q in out) / len(out) > 0.95
    again = {(r.doc_id, r.score) for r in op3_mil_quality(spark, str(tmp_path)).collect()}
    assert {(r.doc_id, r.score) for r in got} == again


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, mil.FEATURES)).astype(np.float32) for n in (1, 4, 2)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss(model):
        s = model.scores(bags)
        return -(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean()

    before, after = mil.fitted(bags, labels, epochs=0), mil.fitted(bags, labels, epochs=150, rate=1e-2)
    assert loss(after) < 0.1 * loss(before)
    # One tiny step of each weight goes against the numeric gradient.
    stepped = mil.fitted(bags, labels, epochs=1, rate=1e-5, decay=0.0)
    for k, v in before.weights.items():
        flat = v.reshape(-1)
        for i in range(min(4, flat.size)):
            kept = flat[i]
            flat[i] = kept + 1e-5
            up = loss(before)
            flat[i] = kept - 1e-5
            down = loss(before)
            flat[i] = kept
            slope, moved = (up - down) / 2e-5, stepped.weights[k].reshape(-1)[i] - kept
            assert abs(slope) < 1e-6 or np.sign(slope) == -np.sign(moved), (k, i)


def test_attention_finds_the_passage_and_sums_to_one():
    rng = np.random.default_rng(1)
    model = mil.fitted([rng.normal(size=(5, mil.FEATURES)).astype(np.float32) for _ in range(8)], np.array([0, 1] * 4, float), epochs=2)
    f = model.forward(rng.normal(size=(7, mil.FEATURES)), np.array([0, 3, 4]))
    assert np.allclose(np.add.reduceat(f["a"], [0, 3, 4]), 1) and len(f["score"]) == 3


def test_long_texts_are_read_whole():
    cache = mil.Words()
    text = ("plain words go here " * 80_000 + "END!! ") .encode()
    got = mil.passages(text, cache)
    assert len(got) == -(-(4 * 80_000 + 1) // mil.PASSAGE)
    assert np.allclose(got[:100], mil.passages(text[: 20 * 1600], cache)[:100])


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert mil.scored(docs, mil.trained(docs, labels)).first().score == 0.5
    assert mil.scored(docs.limit(0), None).collect() == []


def test_training_reads_all_passages_of_long_texts(spark):
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    docs = spark.createDataFrame([(ids[0], "plain words go here " * 8000), (ids[1], "short")], "doc_id long, text string")
    bags, quality = mil.training_bags(docs, spark.createDataFrame([(ids[0], 1), (ids[1], 0)], "doc_id long, quality int"))
    assert [len(b) for b in bags] == [500, 1] and quality.tolist() == [1, 0]


def test_blocks_give_the_same_model(monkeypatch):
    rng = np.random.default_rng(2)
    bags, labels = [rng.normal(size=(n, mil.FEATURES)).astype(np.float32) for n in (3, 9, 1, 4, 6, 2)], np.array([1.0, 0, 1, 0, 1, 0])
    whole = mil.fitted(bags, labels, epochs=5)
    monkeypatch.setattr(mil, "BLOCK", 5)
    assert [o.tolist() for o in mil._blocks(np.arange(6), np.array([3, 9, 1, 4, 6, 2]))] == [[0], [1], [2, 3], [4], [5]]
    parted = mil.fitted(bags, labels, epochs=5)
    assert all(np.allclose(v, parted.weights[k]) for k, v in whole.weights.items())
