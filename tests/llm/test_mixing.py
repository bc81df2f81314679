import pytest
from pyspark.sql import functions as F

from folioscope.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        got = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} | {s: most * sizes[s] for s in capped}
        over = {s for s in free if got[s] > most * sizes[s]}
        if not over:
            return got
        capped |= over


def rows_of(sizes):
    return [(i * 1000 + j, "w " * n, s) for i, (s, (k, n)) in enumerate(sizes.items()) for j in range(k)]


@pytest.mark.parametrize("sizes", [
    {"a": (300, 10), "b": (40, 7), "c": (9, 3), None: (50, 2), "é": (1, 1)},
    {"a": (1, 5)},
    {"a": (10, 5), "b": (3, 0)},
    {"z": (500, 4), "y": (500, 4), "x": (2, 1), "w": (2, 1)},
])
def test_targets_and_draws(spark, sizes):
    docs = spark.createDataFrame(rows_of(sizes), "doc_id long, text string, source string")
    got = mixing.copies(docs).collect()
    want = plain_targets({s: k * n for s, (k, n) in sizes.items()})
    for s, (k, n) in sizes.items():
        own = [r for r in got if r["source"] == s]
        assert len(own) == k and all(r["__target"] == pytest.approx(want[s]) for r in own)
        assert all(0 <= r["__copies"] <= 2 for r in own)
        if k * n:
            rate = want[s] / (k * n)
            assert all(r["__copies"] - rate > -1 and r["__copies"] - rate < 1 for r in own)
            if k >= 300:
                assert sum(r["__copies"] for r in own) * n == pytest.approx(want[s], rel=0.1)
    assert sorted(map(str, got)) == sorted(map(str, mixing.copies(docs).collect()))


def test_mixed_repeats_rows_and_keeps_columns(spark):
    rows = [(1, "a b", "s", 9), (1, "a b", "s", 9), (None, "c", None, 8), (2, None, "s", 7), (3, "", "t", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mixed(docs)
    counts = {r["doc_id"]: r["__copies"] for r in mixing.copies(docs).collect()}
    assert out.columns == docs.columns
    assert out.filter(F.col("doc_id") == 1).count() == 2 * counts[1]
    assert mixing.mixed(docs.limit(0)).count() == 0
