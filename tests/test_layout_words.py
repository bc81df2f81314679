"""Words cut from runs and lines, and rows of boxes: each text is gone through once, and pages aren't shuffled."""

import pytest

from folioscope.operators import layout
from folioscope.plans import catalog, actions  # noqa: F401

DATA = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_runs_are_not_measured_again_for_each_word(spark):
    told = plan(spark, "tokenise_words")
    assert "regexp_count" not in told and told.count("regexp_extract_all") <= 1


def test_lines_are_not_cut_again_for_each_word(spark):
    assert plan(spark, "recognised_line_words").count("regexp_extract_all") <= 1


def test_rows_of_pages_need_no_shuffle(spark):
    assert "Exchange" not in plan(spark, "row_grouping")


def test_words_of_odd_runs(spark):
    """Wide spaces, letters of four bytes, empty and null texts; a run that is turned upwards."""
    rows = [("a", 1, 0, " x\U0001d54f\t　é9  "), ("a", 1, 1, ""), ("a", 1, 2, None), ("b", 2, 0, " "), ("b", 2, 1, "ab")]
    runs = spark.createDataFrame([(*r, 100.0, 200.0, 50.0, 10.0, [0.0, 1.0, -1.0, 0.0, 20.0, 30.0] if r[0] == "b" else [1.0, 0.0, 0.0, 10.0, 20.0, 30.0]) for r in rows], "document_id string, page_number int, item_index int, str string, page_width double, page_height double, width double, height double, transform array<double>")
    got = sorted(tuple(r) for r in layout.run_words(runs).collect())
    assert [r[:6] for r in got] == [("a", 1, 0, 0, "x\U0001d54f", 100.0), ("a", 1, 0, 1, "é9", 100.0), ("b", 2, 1, 0, "ab", 100.0)]
    # Widths in ems: 0.61, x 0.59, capital of a script beyond the table 0.70, tab and wide space 0.61 each, é 0.61, 9 0.64, space 0.32 twice.
    whole = 0.61 + 0.59 + 0.70 + 0.61 * 2 + 0.61 + 0.64 + 0.32 * 2
    assert got[0][6] == pytest.approx(0.2 + 0.5 * 0.61 / whole) and got[0][8] == pytest.approx(0.5 * 1.29 / whole)
    assert got[1][6] == pytest.approx(0.2 + 0.5 * (0.61 + 1.29 + 1.22) / whole) and got[1][8] == pytest.approx(0.5 * 1.25 / whole)
    assert got[2][6:] == (pytest.approx(0.1), pytest.approx(0.6), pytest.approx(0.1), pytest.approx(0.25))


def test_words_of_lines_with_and_without_centres(spark):
    rows = [("a", 1, 0, "ab c", [0.1, 0.3, 0.5, 0.9]), ("a", 1, 1, "ab c", [0.1, 0.3]), ("a", 1, 2, "ab c", None), ("a", 1, 3, None, [0.1]), ("a", 1, 4, "q", [0.25])]
    lines = spark.createDataFrame([(*r, 90.0, 0.0, 0.2, 1.0, 0.02) for r in rows], "document_id string, page_number int, line_index int, text string, char_offsets array<double>, confidence double, x double, y double, width double, height double")
    got = {(r.line_index, r.token_index): (r.text, round(r.x, 6), round(r.width, 6)) for r in layout.line_words(lines).collect()}
    even = {0: ("ab", 0.0, 0.5), 1: ("c", 0.75, 0.25)}
    assert got == {(0, 0): ("ab", 0.0, 0.4), (0, 1): ("c", 0.7, 0.2), **{(k, i): v for k in (1, 2) for i, v in even.items()}, (4, 0): ("q", 0.25, 0.0005)}
