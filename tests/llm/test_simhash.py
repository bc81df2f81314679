import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import simhash
from folioscope.llm.queries import op8_simhash_anchors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_print(text, k=4, seed=42):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 31), st.integers(0, 31))
def test_blocks_two_bits_apart_share_an_anchor(x, p, q):
    y = x ^ (1 << p) ^ (1 << q)
    sent = [set(np.concatenate([a for _, a in simhash.anchors_of(np.array([v], np.uint64), 32)]).tolist()) for v in (x, y)]
    assert sent[0] & sent[1]
    assert len(sent[0]) in (2, 17)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 700))) for _ in range(120)]
    for i in range(0, 60):
        words = texts[i].split()
        for _ in range(1):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [None, "", " \t\n", "one", "One", "one two", "É é", "x" * 3000, texts[0], texts[0], "a b c d " * 4000]
    rows = [(i, t, None, "s", None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "f0").write.parquet(f"{tmp_path}/documents.parquet")
    prints = [plain_print(t) for t in texts]
    roots = plain_components(prints, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op8_simhash_anchors(spark, str(tmp_path)).collect()}
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in range(len(texts))}
    assert len(set(roots)) < len(texts) - 20


def test_large_anchors_give_the_same_components():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    prints = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 3)).astype(np.uint64), axis=1) for b in base] + [rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    forest = simhash.Forest()
    for a, b in simhash._links_within([prints], 4):
        assert (np.bitwise_count(prints[a] ^ prints[b]) <= 4).all()
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            forest.join(x, y)
    want = plain_components(prints.tolist(), 4)
    assert [forest.root(i) for i in range(len(prints))] == want


def test_two_seeds_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(40)]
    for i in range(40):
        words = texts[i].split()
        for _ in range(i % 8):
            words[rng.randrange(len(words))] = "new"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.components(docs, bits=23, least=None).collect()}
    both = [got[i].f0 % 2**64 << 64 | got[i].f1 % 2**64 for i in range(len(texts))]
    assert [got[i].component_id for i in range(len(texts))] == plain_components(both, 23)


def test_deduplicated_keeps_one_of_a_group_and_all_columns(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(3, text, "x"), (3, text, "x"), (5, text, "y"), (None, text, "z"), (None, "something else entirely here today", "z"), (7, None, None), (8, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __fs_note string")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted([docs.collect()[i] for i in (0, 4, 5)], key=str)
    assert simhash.deduplicated(docs.limit(0)).collect() == []


def jaccard(a, b, k=5):
    x, y = ({tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} for ws in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_confirmed_links_equal_exact_similarity(spark):
    """Pairs from 0.6 to 0.95: those of 0.8 or more link, others don't."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts, pairs = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randint(60, 300))
        other = list(words)
        aim = 0.6 + 0.35 * (i % 50) / 50
        while jaccard(" ".join(words), " ".join(other)) > aim:
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(other)]
    got = {r.doc_id: r.component_id for r in simhash.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    likeness = {p: jaccard(*(texts[i] for i in p)) for p in pairs}
    linked = {p for p in pairs if got[p[1]] == got[p[0]]}
    assert not {p for p in linked if likeness[p] < 0.8}
    want = {p for p in pairs if likeness[p] >= 0.8}
    assert len(want) > 100 and len(linked) >= 0.98 * len(want)
    assert all(got[i] in (i, i - i % 2) for i in range(len(texts)))


def test_set_fingerprints_equal_counted_bits():
    rng = random.Random(14)
    for n in (0, 1, 4, 7, 300, 9000):
        text = " ".join(f"Word{rng.randrange(4000)}" for _ in range(n))
        text += " " + text
        hashes = [int(h) for h in simhash.shingles(text.encode(), 5)]
        got = simhash.set_simhash(text.encode(), 5, 3).tolist()
        drawn = [[int(x) for x in simhash.mixed_bits(np.array(hashes, np.uint64), i)] for i in range(3)]
        assert got == [sum((2 * sum(x >> b & 1 for x in own) > len(hashes)) << b for b in range(64)) for own in drawn]
    assert simhash.set_simhash(None, 5, 3).tolist() == [0, 0, 0]


def test_bits_of_sets_keep_similarities_of_eight_tenths():
    """Sets at 0.8 or just above, small and large: candidates; sets at 0.5: not."""
    rng = np.random.default_rng(15)

    def print_of(hashes):
        ones = np.concatenate([np.unpackbits(simhash.mixed_bits(hashes, i)[:, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(simhash.WORDS)])
        return 2 * ones > len(hashes)

    def far(common, a, b):
        x, y, z = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (common, a, b))
        return int((print_of(np.concatenate([x, y])) != print_of(np.concatenate([x, z]))).sum())

    near = [far(*sizes) <= simhash.SET_BITS for sizes in ((8, 1, 1), (12, 0, 3), (12, 1, 2), (20, 2, 3), (80, 10, 10), (400, 0, 100), (800, 100, 100)) for _ in range(100)]
    assert np.mean(near) >= 0.995
    assert not any(far(200, 100, 100) <= simhash.SET_BITS for _ in range(100))


def test_nearly_all_of_a_large_family_go(spark):
    """Two hundred copies with a few changes each: every one has a partner at 0.8 or more, which may not be among its nearest by fingerprint."""
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(5000)]
    words = rng.choices(vocabulary, k=200)
    texts = [" ".join(words)]
    for _ in range(200):
        own = texts[rng.randrange(len(texts))].split()
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    kept = simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kept = {r.doc_id for r in kept.collect()}
    assert 0 in kept and len(kept) <= 3


@pytest.mark.parametrize("likeness", [0.82, 0.85])
def test_links_within_a_family_of_a_template(spark, likeness):
    """Pages that share a template, at 0.76 to each other, of which sixty have a partner: nearly all of a page's candidates are false."""
    rng = random.Random(int(likeness * 100))
    template = [f"t{i}" for i in range(260)]

    def page(start, n):
        return template[: start] + [f"u{rng.randrange(10**9)}" for _ in range(n)] + template[start:]

    # Equal sets of s shingles that share c of them have a similarity of c / (2 s - c).
    pages = [page(130, 36) for _ in range(300)]
    texts = [" ".join(p) for p in pages]
    pairs = []
    for i in range(60):
        own, other = pages[i], list(pages[i])
        at = 130
        while jaccard(" ".join(own), " ".join(other)) > likeness and at < 166:
            other[at] = f"v{rng.randrange(10**9)}"
            at += 1
        if jaccard(" ".join(own), " ".join(other)) < likeness:
            other[at - 1] = own[at - 1]
        assert likeness <= jaccard(" ".join(own), " ".join(other)) < likeness + 0.03
        pairs.append((i, len(texts)))
        texts.append(" ".join(other))
    assert 0.7 < jaccard(texts[0], texts[1]) < 0.79
    got = {r.doc_id: r.component_id for r in simhash.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 58
    partner = {b: a for a, b in pairs}
    assert all(got[i] in (i, partner.get(i)) for i in range(len(texts)))  # and no other


def test_a_crowded_family_sends_its_forest_only(spark):
    """300 near copies in one task: a row for each but one, all told to be crowded; three nodes beside them keep all of their links."""
    rng = np.random.default_rng(21)

    def near(base, n):
        flips = np.zeros((n, 512), np.uint8)
        for row in flips:
            row[rng.choice(512, 20, replace=False)] = 1
        return base ^ np.packbits(flips, axis=1, bitorder="little").view("<u8")

    prints = np.concatenate([near(rng.integers(0, 2**63, 8, dtype=np.uint64), n) for n in (300, 3)]).view(np.int64)
    nodes = spark.createDataFrame([(i, *row) for i, row in enumerate(prints.tolist())], "node long, " + ", ".join(f"f{i} long" for i in range(8)))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = simhash.links(simhash.replicas(nodes, 8, 4, 2), 8, simhash.SET_BITS, True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    family = [r for r in rows if max(r.a, r.b) < 300]
    assert len(family) == 299 and all(r.tree for r in family)
    told = {n for r in family for n, bit in ((r.a, simhash.CROWDED_A), (r.b, simhash.CROWDED_B)) if r.d & bit}
    assert told == set(range(300))
    assert {(max(r.a, r.b), min(r.a, r.b)) for r in rows if min(r.a, r.b) >= 300} == {(301, 300), (302, 300), (302, 301)} and len(rows) == 302


def test_block_links_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 55, replace=False), rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(40)]
    rows = [(1, 100 + i, i % 7 if i % 3 else i, s) for i, s in enumerate(sets)]
    for size in (100, 1 << 22):
        monkeypatch.setattr(simhash, "SHARED_AT_ONCE", size)
        for first, second in ((rows, None), (rows[:15], [(2, *r[1:]) for r in rows[15:]])):
            got, want = simhash.Forest(), simhash.Forest()
            links = simhash.block_links(first, second, 0.8)
            for a, b in links:
                got.join(rows[a - 100][2], rows[b - 100][2])
            for x in first:
                for y in second or first:
                    both = len(np.intersect1d(x[3], y[3]))
                    if x[2] != y[2] and both >= 0.8 * (len(x[3]) + len(y[3]) - both):
                        want.join(x[2], y[2])
            roots = {r[2] for r in rows}
            assert links and {r: got.root(r) for r in roots} == {r: want.root(r) for r in roots}
    assert simhash.block_links(rows[:1], None, 0.8) == []


def test_all_longs_are_doc_ids(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(2**63 - 1, text), (2**62 + 7, text), (None, text), (-(2**63), "another text of five words"), (2**62, "one more text of words"), (None, "no name for this text"), (None, "no name for this text")]
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, bits=4, seeds=(42,), blocks=2, least=None).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(2**63 - 1, 2**62 + 7), (2**62 + 7, 2**62 + 7), (None, 2**62 + 7), (-(2**63), -(2**63)), (2**62, 2**62), (None, None), (None, None)], key=str)


def test_strangers_do_not_meet(spark, monkeypatch):
    """Of 1500 unlike texts few meet, so that comparisons don't grow with the square of a corpus; a pair of near copies does."""
    rng = random.Random(22)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(30, 200))) for _ in range(1500)]
    texts.append(texts[0] + " and one more")
    sent, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda s, *rest: sent.append(s) or links(s, *rest))
    got = {r.doc_id: r.component_id for r in simhash.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i % 1500 for i in range(1501)}
    assert sum(r["count"] * (r["count"] - 1) // 2 for r in sent[0].groupBy("anchor").count().collect()) < 100


def test_alike_sets_have_a_band_in_common():
    """Sets at 0.8, small and large; those of 0.2 seldom."""
    rng = np.random.default_rng(23)

    def meet(common, a, b):
        x, y, z = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (common, a, b))
        return bool((simhash.band_keys(np.unique(np.concatenate([x, y]))) == simhash.band_keys(np.unique(np.concatenate([x, z])))).any())

    for sizes in ((4, 0, 1), (8, 1, 1), (12, 0, 3), (20, 2, 3), (80, 10, 10), (400, 0, 100), (3200, 400, 400)):
        assert np.mean([meet(*sizes) for _ in range(400)]) >= 0.99
    assert np.mean([meet(100, 200, 200) for _ in range(400)]) < 0.05
    assert len(simhash.band_keys(np.zeros(0, np.uint64))) == 0 and len(set(simhash.band_keys(np.array([7], np.uint64)).tolist())) == simhash.BANDS
