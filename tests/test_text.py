import datetime
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import dates, encoding, glyphs, repair, text
from folioscope.functions.glyphs import CAPITAL, DIGIT, OTHER, WIDTH_OF



def of(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", column(F.col("t")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def plain_search(s):
    flat = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.category(c).startswith("M"))
    flat = "".join(c for c in flat.replace("ı", "i").replace("ə", "") if unicodedata.category(c) != "Lm")
    return "".join(c for c in flat if unicodedata.category(c)[0] in "LN")


def test_search_keys(spark):
    values = ["Azərbaycan", "Azrbaycan", "oʻ", "İSTANBUL ı", "ﬁne ½ №7", " a-b. ", "", None, "ñandú Straße", "２０２４"]
    got = of(spark, values, text.normalize_for_search)
    assert got == [None if v is None else plain_search(v) for v in values]
    assert got[0] == got[1] and got[2] == "o"
    assert of(spark, ["(Two-words!)", "— x"], text.normalize_token) == ["two-words", "— x"]


#: Characters that every runtime knows alike; a sigma's lower case depends on what a runtime takes for the end of a word.
SETTLED = st.characters(min_codepoint=32, max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"], exclude_characters="\u03a3").filter(lambda c: unicodedata.ucd_3_2_0.category(c) != "Cn")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(SETTLED, max_size=12), min_size=20, max_size=40))
def test_search_keys_equal_the_steps_in_order(spark, values):
    """Lower case comes before the decomposition, so a double-struck capital, which has no lower case, leaves a capital: keys of keys may differ."""
    assert of(spark, [*values, "\u2115"], text.normalize_for_search) == [plain_search(v) for v in [*values, "\u2115"]]


def test_report_text(spark):
    assert of(spark, ["  a\u0007b  c ", "Ã¼ber É™", "x" * 5000, None, ""], text.clean_report_text) == ["a b c", "über ə", "x" * 4000, None, ""]
    assert of(spark, ["\n ab\n 12\nTitle here\nz", "", None], text.title_from_text) == ["Title here", "", ""]
    assert of(spark, ["Şəhər Günü!", "---", "a" * 59 + "-b"], text.slug) == ["seher-gunu", "item", "a" * 59]


def test_legacy_fonts(spark):
    assert of(spark, ["Àçÿðáàéúàíûí", "ийул", "Übung für", "ийул"], encoding.decoded) == ["Azərbaycanın", "iyul", "Übung für", "iyul"]
    assert of(spark, ["éàü", "é à plain words follow here for long", "ab"], encoding.has_byte_font) == [True, False, False]


def test_languages(spark):
    assert of(spark, ["az+EN, ru", "xx", "", None, "tr+aze"], text.parsed_languages) == [["aze", "eng", "rus"], None, None, None, ["aze", "tur"]]
    assert of(spark, ["ru+az", "xx"], text.scripts_of) == [["latin", "cyrillic"], ["latin"]]
    assert of(spark, ["aze", "az+en", "eng", "bazeline"], repair.needs_repair) == [True, True, False, True]


def test_origins_and_settings(spark):
    assert of(spark, ["https://a.b", "https://x-1.c", "https://x.c.evil"], lambda c: text.origin_allowed(c, ["https://a.b", "https://*.c"])) == [True, True, False]
    assert of(spark, ["", "0", "2.5", "-1", "x", None], lambda c: text.number_setting(c, 7)) == [7, 0, 2.5, 7, 7, 7]
    assert of(spark, ["", "0", "2.5", "0.5", "99"], lambda c: text.positive_setting(c, 7, 50, True)) == [7, 7, 2, 7, 50]
    assert of(spark, ["a.b.docx", ".pdf", "x"], text.viewer_name) == ["a.b.pdf", "document.pdf", "x.pdf"]


@pytest.mark.parametrize(("name", "want"), [
    ("My_Paper_24.07.2026.pdf", ("My Paper", "24.07.2026", True)),
    ("X_31.02.2026.pdf", ("X 31.02.2026", "31.01.2024", False)),
    ("X_24.07.2026", ("X 24.07", "31.01.2024", False)),
    ("24.07.2026 X.pdf", ("X", "24.07.2026", True)),
    ("a_1-2/2024.pdf", ("a", "01.02.2024", True)),
    ("_.pdf", ("Unknown", "31.01.2024", False)),
])
def test_file_names(spark, name, want):
    r = of(spark, [name], lambda c: dates.parsed_file_name(c, F.to_date(F.lit("2024-01-31"))))[0]
    assert (r.author, r.date_text, r.from_name) == want and isinstance(r.date, datetime.date)


def test_repairs(spark):
    assert of(spark, ["mğmkğn", "başlanğıcı", "bğğd", None], repair.umlauts) == ["mümkün", "başlanğıcı", "bğğd".replace("ğğ", "üğ"), None]
    assert of(spark, ["v", "B", "v à il", "ab v"], repair.lone_consonants) == ["və", "B", "və àə il", "ab və"]


def centres(s):
    widths = [WIDTH_OF.get(c) or (DIGIT if "0" <= c <= "9" else CAPITAL if c.isupper() else OTHER) for c in s]
    at, out = 0.0, []
    for w in widths:
        out.append((at + w / 2) / sum(widths))
        at += w
    return out


def test_schwas(spark):
    full = "məktəb salam dostlar"
    lines = [("mktb salam dostlar", [c for c, x in zip(centres(full), full, strict=True) if x != "ə"]), ("mktb", [c for c, x in zip(centres("məktəb"), "məktəb", strict=True) if x != "ə"]), ("∃v", None), ("short", [0.1])]
    df = spark.createDataFrame(lines, "text string, char_offsets array<double>").withColumn("n", F.monotonically_increasing_id())
    got = [r.o for r in df.coalesce(1).select("n", repair.restored_schwa(F.col("text"), F.col("char_offsets")).alias("o")).orderBy("n").collect()]
    assert [g.text for g in got] == ["məktəb salam dostlar", "mktb", "Əv", "short"]
    assert got[0].inserted == 2 and len(got[0].char_offsets) == len(full)
    done = repair.repaired_lines(df, F.lit("aze")).orderBy("n").collect()
    assert done[0].text == full and len(done[0].char_offsets) == len(full)
    assert [r.text for r in repair.repaired_lines(df, F.lit("eng")).orderBy("n").collect()] == [x for x, _ in lines]


def test_glyphs_and_ranks(spark):
    assert of(spark, ["aW1Ж ж", ""], glyphs.text_width) == [pytest.approx(0.61 + 0.99 + 0.64 + 0.70 + 0.32 + 0.61), 0]
    assert of(spark, ["ab"], glyphs.width_prefix) == [[0.0, 0.61, pytest.approx(1.25)]]
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "a array<double>")
    assert [r.o for r in df.select(repair.nearest_rank(F.col("a"), 0.4).alias("o")).collect()] == [2.0, 0.0]


def plain_restored(text_, offsets):
    if text_ is None:
        return None, None, 0
    text_ = "".join("Ə" if c in "∃∀" else c for c in text_)
    at = list(offsets or [])
    width = lambda c: WIDTH_OF.get(c) or (DIGIT if "0" <= c <= "9" else CAPITAL if c.isupper() else OTHER)
    gaps = {i: (at[i + 1] - at[i], (width(a) + width(b)) / 2) for i, (a, b) in enumerate(zip(text_, text_[1:], strict=False)) if len(at) == len(text_) and a.isalpha() and b.isalpha()}
    open_ = [i for i in gaps if text_[i] not in repair.VOWELS and text_[i + 1] not in repair.VOWELS]
    ranked = sorted(g / w for g, w in gaps.values())
    scale = ranked[int((len(ranked) - 1) * 0.4 + 0.5)] if ranked else 0
    if len(gaps) < 3 or not open_ or not scale > 0:
        return text_, at, 0
    out, places, added = "", [], 0
    for i, c in enumerate(text_):
        out, places = out + c, [*places, at[i]]
        if i in open_ and gaps[i][0] / scale - gaps[i][1] >= 0.30:
            schwa = "Ə" if c.isupper() and text_[i + 1].isupper() else "ə"
            n = min(2, max(1, int((gaps[i][0] / scale - gaps[i][1]) // width(schwa))))
            out, added = out + schwa * n, added + n
            places += [at[i] + gaps[i][0] * k / (n + 1) for k in range(1, n + 1)]
    return out, places, added


def test_schwas_equal_the_rule_step_by_step(spark):
    import random

    rng = random.Random(31)
    rows = [(None, None), ("", []), ("a", [0.1]), ("mktb", None), ("∃∀", [0.1, 0.2]), ("bbb", [0.3, 0.2, 0.1]), ("bdf", [0.1, 0.1, 0.1])]
    for _ in range(300):
        t = "".join(rng.choice("abdkLMTəüÉ 7∃") for _ in range(rng.randint(1, 14)))
        at, x = [], 0.0
        for _ in t:
            x += rng.choice([0.5, 0.6, 0.7, 1.3, 2.1])
            at.append(x)
        rows.append((t, at if rng.random() < 0.9 else at[1:]))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, o array<double>").select("i", repair.restored_schwa(F.col("t"), F.col("o")).alias("r"))
    assert "Python" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: (r.r.text, r.r.char_offsets, r.r.inserted) for r in df.collect()}
    for i, (t, o) in enumerate(rows):
        want = plain_restored(t, o)
        assert (got[i][0], got[i][2]) == (want[0], want[2]), (t, o)
        assert got[i][1] == (want[1] if want[1] is None else pytest.approx(want[1]))
    assert sum(g[2] > 0 for g in got.values()) > 50


def test_a_page_decides_for_its_words(spark):
    pages = [["ñà", "ëì", "plain", "àá"], ["plain", None, "ñ"], [], None, ["сал", "ам", "x"], ["é"] * 2]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, w array<string>").select("i", encoding.repaired_page(F.col("w")).alias("r"))
    got = {r.i: (r.r.words, r.r.repaired) for r in df.collect()}
    assert got[0] == (["sa", "lm", "plain", "ab"], True) and got[1] == (pages[1], False) and got[2] == ([], False) and got[3][0] is None
    assert got[4] == (["sal", "am", "x"], True) and got[5] == (pages[5], False)
    assert of(spark, ["ñà"], encoding.decoded) == ["ñà"]  # alone it wouldn't be told
