import collections
import random

import corpus_pipeline
from folioscope.llm import mil, mixing, packing, pii, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __fs_score string"


def write(spark, path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randint(20, 300))
        good = i % 5 != 0
        if not good:
            words = [w.upper() + "!!" for w in words]
        if i % 6 == 1:
            words[5] = f"u{i}@mail.example.com"
        rows.append((i, " ".join(words), "en", rng.choice(["hot", "hot", "b", "c", None]), None, "own"))
        labels.append((i, int(good), 0))
    for i in range(1, 60):
        words = rows[i][1].split()
        words[len(words) // 2] = "changed"
        rows.append((1000 + i, " ".join(words) if i % 2 else rows[i][1], "en", "b", None, None))
    rows += [(2000, "", None, None, None, None), (2001, None, "en", "c", None, None), (None, "a text without any id at all", "en", "c", None, None), rows[7]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, labels


def test_stages_equal_brute_force(spark, tmp_path):
    rows, labels = write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "privacy", "mix", "pack"]

    model = mil.trained(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    cache = mil.Words()
    good = stages["quality"](spark, docs, str(tmp_path))
    want = [r for r in rows if model.scores([mil.passages((r[1] or "").encode(), cache)])[0] >= mil.KEEP]
    assert sorted(map(tuple, good.collect()), key=str) == sorted(want, key=str) and good.columns == columns
    assert not {i for i, q, _ in labels if not q} & {r[0] for r in want}
    assert len({i for i, q, _ in labels if q} - {r[0] for r in want}) <= 3

    single = stages["near_duplicates"](spark, good, str(tmp_path))
    key = lambda r: r[0] if r[0] is not None else 1 << 62
    order = sorted(want, key=key)
    shingles = [set(simhash.shingles((r[1] or "").encode(), 5).tolist()) for r in order]
    gone = [False] * len(order)
    group = list(range(len(order)))
    for i in range(len(order)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    kept = [r for i, r in enumerate(order) if group[i] == i and not gone[i]]
    assert sorted(map(tuple, single.collect()), key=str) == sorted(kept, key=str) and single.columns == columns
    assert len(kept) < len(want) - 20

    private = stages["privacy"](spark, single, str(tmp_path))
    want = [(r[0], pii.permuted(r[1], pii.key_of(spark))[0] if r[1] is not None else None, *r[2:]) for r in kept]
    assert sorted(map(tuple, private.collect()), key=str) == sorted(want, key=str)
    assert not any(r[0] is not None and r[0] < 400 and f"u{r[0]}@" in (r[1] or "") for r in want)

    mixed = stages["mix"](spark, private, str(tmp_path)).collect()
    times = {(r["doc_id"], r["text"]): r["__copies"] for r in mixing.copies(private).collect()}
    assert collections.Counter((r.doc_id, r.text) for r in mixed) == {k: n for k, n in times.items() if n}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.copy) for r in got if r.piece == 0).total() == len(mixed)
    assert sum(r.size for r in got) == sum(len((r.text or "").split()) for r in mixed)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    for own in bins.values():
        assert sum(r.size for r in own) <= packing.CAPACITY
        some = [r.doc_id for r in own if r.size]
        assert len(set(some)) == len(some)
        assert max(collections.Counter(r.source for r in own).values()) <= packing.PER_SOURCE
