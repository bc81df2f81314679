import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import lexical

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain(docs, items, most=50):
    """Term by term: {(item, rank, doc, score)}."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n, length = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in of.items():
        found = []
        for d, c in bags:
            m = 50 + 50 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:most])]
    return sorted(out, key=str)


def got(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, rank string")
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    return sorted(map(tuple, lexical.ranked(d.repartition(3), q, **how).collect()), key=str)


WORDS = ["the", "The", "été", "ÉTÉ", "a1", "x_y", "naïve", "日本", "the-end", "a b", "q\u0085r", "T", "ﬁ", "İ"]


def test_edges_ties_and_repeats(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice([" ", ".", "\n", "--"]).join(rng.choice(WORDS) for _ in range(rng.randint(1, 30)))) for i in range(150)]
    docs += [(500 + i, "same the same été") for i in range(80)] + [(None, "the été only"), (7, None), (8, ""), (9, " .,! "), (3, docs[3][1]), (3, "other a1 text"), (2**62 + 5, "same the same été")]
    docs += [(900, "zz " * 400_000 + "a1 the")]
    items = [(1, "The été."), (1, "a1"), (2, None), (3, ""), (4, "nowhere-found"), (None, "naïve 日本"), (5, "same"), (6, "zz"), (7, "x" * 5000 + " fi"), (8, "r q b")]
    want = plain(docs, items)
    assert got(spark, docs, items) == want
    assert len([w for w in want if w[0] == 5]) == 50
    assert got(spark, docs, items, block_bytes=40) == want  # items in several blocks
    assert got(spark, docs, items, items_at_once=2, most=50) == want
    assert got(spark, docs, items, most=3) == plain(docs, items, 3)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == [] and got(spark, [(1, "a")], []) == [] and got(spark, [(1, None)], [(1, "a")]) == []


@pytest.mark.parametrize("step", [1, 2, 7])
def test_the_best_don_t_depend_on_parts(step):
    """Documents come in parts of any size, and the best settle at any time."""
    rng = random.Random(step)
    best = lexical.Best(3, 4)
    rows = [(d, [rng.randint(0, 5) for _ in range(3)]) for d in range(60)]
    rng.shuffle(rows)
    for i in range(0, 60, step):
        part = rows[i : i + step]
        best.add(np.array([s for _, s in part]), np.array([d for d, _ in part]), np.zeros(len(part), bool))
        if i % 3 == 0:
            best.settle()
    item, score, doc, _ = best.settle()
    for j in range(3):
        want = sorted((-s[j], d) for d, s in rows if s[j] > 0)[:4]
        assert [(-s, d) for i, s, d in zip(item.tolist(), score.tolist(), doc.tolist(), strict=True) if i == j] == want


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.text(st.sampled_from("abAB é.\x00\x7f日 "), max_size=30)), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 3), st.text(st.sampled_from("abAB é.日 "), max_size=8)), min_size=1, max_size=8))
def test_equals_brute_force(spark, docs, items):
    assert got(spark, docs, items) == plain(docs, items)


def test_plan_has_no_join_of_documents(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    plan = lexical.ranked(d, q)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan
