import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import turns

SPACE = " \t\n\v\f\r"


def after_damage(rows):
    """conv_id -> rows in order. rows: (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out.setdefault(conv, []).extend([] if k == 0 else [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1))
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), digest(r))) for c, own in out.items()}


def cheapest(codes):
    """(cost, edits): by recursion over all edits; codes: (initial, must go, truncated)."""
    n = len(codes)

    @cache
    def best(i, q, inserts):  # q: the regular expression's state by what came last: "", s, u, a
        options = [(0, "")] if i == n and q in ("", "a") else []
        asked = "a" if q == "u" else "u"
        if inserts:
            c, e = best(i, asked, inserts - 1)
            options.append((c + 5, "I" + e))
        if i < n:
            initial, gone, cut = codes[i]
            moves = [("D", 2, q)]
            if not gone:
                moves.append(("R", 1 + 5 * cut, asked))
                if initial == asked or initial == "s" and q == "":
                    moves.append(("K", 5 * cut, initial))
            for e, c, to in moves:
                rest = best(i + 1, to, 2)
                options.append((c + rest[0], e + rest[1]))
        return min(options, default=(10**9, ""))

    for i in range(n, -1, -1):  # from the end, so that the recursion is never deep
        for q in ("", "s", "u", "a"):
            best(i, q, 2)
    return best(0, "", 2)


def plain(rows):
    out = []
    for conv, own in after_damage(rows).items():
        seen, faults, codes = set(), [0, 0, 0], []
        for _, role, text in own:
            told = text.rstrip(SPACE)
            fault = 0 if not told else 1 if (role, text) in seen else 2 if told[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            codes.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit = cheapest(codes)
        told = {t for t, _, _ in own if t is not None}
        gaps = max(told) - min(told) + 1 - len(told) if told else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:], strict=False))
        lines, left = [], iter(own)
        for e in audit:
            row = next(left) if e != "I" else None
            if e != "D":
                # The pattern leaves no choice: a user first, or after a system row, then in turn.
                start = bool(lines) and lines[0].startswith("s")
                role = ("user", "assistant")[(len(lines) - start) % 2]
                lines.append(f"{row[1] if e == 'K' else role}:{row[2] if row else ''}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def reported(spark, rows, **how):
    df = spark.createDataFrame([(*r, True) for r in rows], "conv_id long, turn long, role string, text string, gone boolean")
    return sorted(map(tuple, turns.reported(turns.repaired(turns.damaged(df.repartition(3)), **how)).collect()), key=str)


def some(rng, convs, most):
    rows = []
    for c in range(convs):
        texts = [f"text {i}{rng.choice(['.', '!', '', ' ', '?' + chr(10)])}" for i in range(rng.randint(2, 6) if rng.random() < 0.5 else most)]
        for t in range(rng.randint(1, most)):
            rows.append((c, t + rng.choice([0, 0, 0, 3]) if rng.random() < 0.97 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice([*texts, " \n", None])))
    return rows


def test_equals_brute_force_with_chunks_of_any_size(spark):
    rng = random.Random(11)
    rows = some(rng, 60, 40)
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (77, None, None, None), (78, 0, "user", "\x85 ."), (79, 5, "assistant", "x" * 70 + "b."), (79, 5, "assistant", "x" * 70 + "a.")]
    want = plain(rows)
    assert any(w[7] == "" for w in want) and len(want) == 64
    for how in ({}, {"chunk_rows": 3, "chunk_bytes": 40}):
        assert reported(spark, rows, **how) == want


def test_conversations_without_rows_and_empty_tables(spark):
    gone = next(t for t in itertools.count() if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert reported(spark, [(5, gone, "user", "x.")]) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert reported(spark, []) == []


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(12)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), f"line {t}" + rng.choice([".", ""])) for t in range(1500)] + some(rng, 5, 6)
    rows = [(r[0] + 10 if i >= 1500 else r[0], *r[1:]) for i, r in enumerate(rows)]
    want = plain(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = turns.repaired(turns.damaged(df), chunk_rows=50)
        assert found.filter("conv_id = 1").count() > 25
        assert turns.chunks(turns.damaged(df)).filter("conv_id = 1").select("part").distinct().count() > 2
        assert sorted(map(tuple, turns.reported(found).collect()), key=str) == want
        # The turns themselves, put together again, have the digest that is reported.
        lines = {}
        for r in sorted(turns.repaired_turns(found).collect(), key=lambda r: (r.no, r.place)):
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert all(hashlib.sha256("\n".join(lines.get(w[0], [])).encode()).hexdigest() == w[-1] for w in want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


CODES = st.lists(st.sampled_from([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(CODES)
def test_least_edits(codes):
    of = [(" sua"[c & 3].strip(), bool(c & turns.MUST_GO), bool(c & turns.CUT)) for c in codes]
    cost, audit = cheapest(of)
    assert turns.traced(bytes(codes), turns.ENDING, (turns.START,), True)[0][0] == audit
    v = turns.ENDING
    for c in reversed(codes):
        v = turns.before(c, v)
    assert v[turns.START] == cost


@settings(max_examples=300, deadline=None)
@given(CODES, st.tuples(*[st.integers(0, 12)] * 4), st.tuples(*[st.integers(0, 12)] * 4))
def test_a_fix_up_pass_equals_a_new_run(codes, was, now):
    codes = bytes(codes)
    start, again = turns.fixed_up(codes, was, turns.arrived(codes, was), now)
    assert start == turns.arrived(codes, now) and again <= len(codes)


def test_exhaustive():
    """All edits of two rows, with up to two insertions in each gap, put into the expression itself."""
    gaps = ["", "u", "a", "ua", "au"]
    for codes in itertools.product([0, 1, 2, 3, 4, 6, 8, 10, 11], repeat=2):
        found = []
        for edits, between in itertools.product(itertools.product("KUAD", repeat=2), itertools.product(gaps, repeat=3)):
            if any(c & turns.MUST_GO and e != "D" for c, e in zip(codes, edits, strict=True)):
                continue
            roles, audit, cost = "", "", 0
            for i, gap in enumerate(between):
                roles, audit, cost = roles + gap, audit + "I" * len(gap), cost + 5 * len(gap)
                if i < 2:
                    c, e = codes[i], edits[i]
                    roles += "" if e == "D" else "xsua"[c & 3] if e == "K" else e.lower()
                    audit += "R" if e in "UA" else e
                    cost += 2 if e == "D" else (e != "K") + (5 if c & turns.CUT else 0)
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
        assert turns.traced(bytes(codes), turns.ENDING, (turns.START,), True)[0][0] == min(found)[1]
