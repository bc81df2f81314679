import random

from folioscope.llm import packing


def plain_best_fit(items, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in items:
        fit = [(capacity - sum(s for s, _, _ in b), i) for i, b in enumerate(bins) if capacity - sum(s for s, _, _ in b) >= size and sum(x == source for _, x, _ in b) < per_source and (cluster is None or all(c != cluster for _, _, c in b))]
        i = min(fit)[1] if fit else len(bins)
        if i == len(bins):
            bins.append([])
        out.append((i, sum(s for s, _, _ in bins[i])))
        bins[i].append((size, source, cluster))
    return out


def test_best_fit_equals_brute_force():
    for seed in range(30):
        rng = random.Random(seed)
        items = [(rng.choice([0, 1, 5, 20, 20, 33, 50, 100]), rng.choice([None, "a", "a", "a", "b", "c"]), rng.choice([None, 1, 1, 1, 2, 3, rng.randrange(99)])) for _ in range(rng.randrange(1, 150))]
        items.sort(key=lambda x: (-x[0], str(x[1]), str(x[2])))
        assert packing.best_fit(items, 100, 2) == plain_best_fit(items, 100, 2)


def test_packed_rows_hold_all_rules(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 400), rng.choice(["hot", "hot", "b", None]), 5) for i in range(400)]
    rows += [(1000, "same words here", "hot", 5)] * 120 + [(None, None, None, None), (2000, "long " * 5001, "b", 5), (2001, "Same words HERE", "c", 1), (2002, "", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    sizes = packing.sized(docs)
    got = packing.packed(sizes, capacity=500, per_source=3, shard_rows=200).collect()
    assert sum(r.size for r in got) == sum(len((r[1] or "").split()) for r in rows)
    assert len({(r.doc_id, r.copy, r.piece) for r in got}) == len(got)
    assert {(r.doc_id, r.copy) for r in got if r.doc_id == 1000} == {(1000, i) for i in range(120)}
    assert sorted(r.size for r in got if r.doc_id == 2000) == [1] + [500] * 10
    bins = {}
    for r in got:
        bins.setdefault(r.bin, []).append(r)
    for rows_of in bins.values():
        assert sum(r.size for r in rows_of) == rows_of[0].fill <= 500
        at = sorted((r["at"], r.size) for r in rows_of)
        assert all(a + s == b for (a, s), (b, _) in zip(at, at[1:], strict=False)) and at[0][0] == 0
        clusters = [r.cluster for r in rows_of if r.cluster is not None]
        assert len(set(clusters)) == len(clusters)
        for s in ("hot", "b", "c", None):
            assert sum(r.source == s for r in rows_of) <= 3
    assert sorted(map(str, got)) == sorted(map(str, packing.packed(sizes, capacity=500, per_source=3, shard_rows=200).collect()))
    assert packing.packed(sizes.limit(0)).collect() == []
