import re
from collections import Counter

from folioscope.llm import rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words int, kept string"


def plain(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark):
    cycle = " ".join(f"c{i}" for i in range(9))
    texts = [None, "", " \n\t\n", "a", "a\na\n a\n\nb\r\na", "x y\nx y\nx y \nx y", " ".join(["w"] * 30), cycle, f"{cycle} {cycle}", f"{cycle} gap {cycle} c0 c1", "a b c d e f g h " * 3, "#*$ %&|<> #", "é😀 ü x y", " ".join(str(i % 5000) for i in range(20_000)), "a b c d e f g h a b c d e f g", "l1\nl2\n" * 500]
    docs = spark.createDataFrame([(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", 1, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in rules.judged(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeats = plain(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), t
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.base_failed and r.kept)
    assert rules.judged(docs.limit(0)).collect() == []


def test_fences_follow_the_group_and_junk_goes(spark):
    import random

    rng = random.Random(3)
    prose = lambda sign: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) + (sign if rng.random() < 0.2 else "") for _ in range(80))
    rows = [(i, prose(""), "en", "plain", 0, "") for i in range(300)]
    rows += [(1000 + i, prose("*"), "en", "markup", 0, "") for i in range(300)]
    rows += [(2000 + i, prose(""), "xx", "rare", 0, "") for i in range(3)] + [(2000, prose(""), "xx", "rare", 0, "")]
    junk = [" ".join(w + "%%%" for w in prose("").split()), prose("").upper(), " ".join(w for x in prose("").split()[:14] for w in [x] * 7), prose("").replace(" ", " | ")]
    rows += [(3000 + i, t, "en", "plain", 0, "") for i, t in enumerate(junk)] + [(4000, junk[0], "xx", "rare", 0, "")]
    kept = {r.doc_id: r.kept for r in rules.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, k in kept.items() if not k} == {3000, 3001, 3002, 3003, 4000}


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 1, "x")], SCHEMA)
    assert not re.search("Python|Pandas|Arrow", rules.judged(docs)._jdf.queryExecution().executedPlan().toString())


def test_verdicts_of_a_large_group_rerun_alike_and_equal_brute_force(spark):
    """5000 rows of one group: kept follows the quartiles of a sketch that is summed in plain Python."""
    import math
    import random

    rng = random.Random(5)
    rows = []
    for i in range(5000):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(60)]
        for j in rng.sample(range(60), rng.choice([0, 0, 1, 3, 12, 30]) if i % 3 == 0 else 0):
            words[j] += "#" if i % 2 else "A"
        rows.append((i, " ".join(words), "en", "hot", 0, ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in rules.judged(docs).collect()}
    again = {r.doc_id: r.kept for r in rules.judged(docs.repartition(7)).collect()}
    assert {i: r.kept for i, r in got.items()} == again
    gamma = (1 + rules.ACCURACY) / (1 - rules.ACCURACY)

    def quartile(values, q):
        counts = Counter(math.ceil(math.log(v) / math.log(gamma)) if v > rules.ZERO else -math.inf for v in values)
        upto = 0
        for b, n in sorted(counts.items()):
            upto += n
            if upto >= q * len(values):
                return 0.0 if b == -math.inf else 2 * gamma**b / (gamma + 1)

    rates = {i: {"symbol_rate": r.n_symbols / r.n_words, "dup_line_rate": r.n_dup_lines / max(1, r.n_lines), "repeat_rate": r.n_repeat_words / r.n_words, "adjacent_rate": r.n_adjacent / r.n_words, "upper_rate": r.n_upper / r.word_chars, "mean_length": r.word_chars / r.n_words} for i, r in got.items()}
    want = {i: not got[i].base_failed for i in rates}
    for m, (slack, both) in rules.MEASURES.items():
        low, high = (quartile([x[m] for x in rates.values()], q) for q in (0.25, 0.75))
        for i, x in rates.items():
            want[i] = want[i] and x[m] <= high + rules.FENCE * (high - low) + slack and (not both or x[m] >= low - rules.FENCE * (high - low) - slack)
    assert {i: r.kept for i, r in got.items()} == want and 100 < sum(want.values()) < 4990
