"""Lines of positioned words: order, text, boxes, segments. Row-wise on arrays, so none of it shuffles."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.glyphs import CAPITAL, DIGIT, OTHER, WIDTH_OF
from folioscope.functions.text import SPACES, clean_report_text, let

# Fixed values.
GLUE, GUTTER_HEIGHTS, LEAST_GUTTER = 0.08, 2.5, 0.02
GRID = 1e5


def by_x(words: Column) -> Column:
    keyed = F.transform(words, lambda w, i: F.struct(w["x"].alias("x"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda k: k["w"])


def raw_line_text(words: Column) -> Column:
    """Words from left to right; no space where the gap is at most GLUE of the lower height."""
    ordered = by_x(words)

    def step(a: Column, w: Column) -> Column:
        glued = w["x"] - a["right"] <= F.least(a["height"], w["height"]) * GLUE
        text = F.concat(a["text"], F.when(a["first"] | glued, "").otherwise(" "), w["text"])
        return F.struct(text.alias("text"), (w["x"] + w["width"]).alias("right"), w["height"].alias("height"), F.lit(False).alias("first"))

    start = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("right"), F.lit(0.0).alias("height"), F.lit(True).alias("first"))
    return F.aggregate(ordered, start, step, lambda a: a["text"])


def line_text(words: Column, most: int = 4000) -> Column:
    return clean_report_text(raw_line_text(words), most)


def box(words: Column) -> Column:
    """struct(x, y, width, height) that holds all words."""
    x = F.array_min(F.transform(words, lambda w: w["x"]))
    y = F.array_min(F.transform(words, lambda w: w["y"]))
    right = F.array_max(F.transform(words, lambda w: w["x"] + w["width"]))
    bottom = F.array_max(F.transform(words, lambda w: w["y"] + w["height"]))
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (bottom - y).alias("height"))


def mean(words: Column, field: str) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda a, w: a + w[field]) / F.greatest(F.size(words), F.lit(1))


def segments(words: Column) -> Column:
    """Arrays of words, cut where a gap is wider than a gutter."""

    def of(ordered: Column) -> Column:
        gutter = F.greatest(mean(ordered, "height") * GUTTER_HEIGHTS, F.lit(LEAST_GUTTER))
        wide = lambda w, i, g: w["x"] - F.get(ordered, i - 1)["x"] - F.get(ordered, i - 1)["width"] > g
        cuts = let(gutter, lambda g: F.filter(F.transform(ordered, lambda w, i: F.when((i > 0) & wide(w, i, g), i)), lambda i: i.isNotNull()))
        return let(cuts, lambda c: F.transform(F.concat(F.array(F.lit(0)), c), lambda s, k: F.slice(ordered, s + 1, F.coalesce(F.get(c, k), F.size(ordered)) - s)))

    return let(by_x(words), of)


def compacted(words: Column, line_of: Column | None = None) -> Column:
    """Words with short ids, coordinates on a grid of 1e-5 and whole confidences; line_of: array of line names, renumbered."""
    grid = lambda v: F.floor(v * GRID + 0.5) / GRID
    names = F.array_distinct(F.filter(line_of, lambda x: x.isNotNull())) if line_of is not None else None

    def word(w: Column, i: Column) -> Column:
        line = F.lit(None).cast("string") if names is None else F.when(F.get(line_of, i).isNotNull(), F.concat(F.lit("l"), (F.array_position(names, F.get(line_of, i)) - 1).cast("string")))
        return F.struct(F.concat(F.lit("w"), i.cast("string")).alias("id"), w["text"].alias("text"), F.floor(w["confidence"] + 0.5).cast("int").alias("confidence"), *(grid(w[k]).alias(k) for k in ("x", "y", "width", "height")), line.alias("line_id"))

    return F.transform(words, word)


def needs_compaction(words: Column) -> Column:
    """Whether the first word lies off the grid."""
    x = F.get(words, F.lit(0))["x"]
    return F.coalesce(F.floor(x * GRID + 0.5) / GRID != x, F.lit(False))


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is one of SPACES, and its glyph's width in hundredths."""
    space, width = np.zeros(0x110000, bool), np.full(0x110000, round(OTHER * 100), np.uint8)
    for first, last in re.findall(r"\\x\{?([0-9A-F]+)\}?(?:-\\x\{?([0-9A-F]+)\}?)?", SPACES):
        space[int(first, 16) : int(last or first, 16) + 1] = True
    width[[c for c in range(0x20000) if unicodedata.category(chr(c)) == "Lu"]] = round(CAPITAL * 100)
    width[ord("0") : ord("9") + 1] = round(DIGIT * 100)
    width[list(map(ord, WIDTH_OF))] = [round(w * 100) for w in WIDTH_OF.values()]
    return space, width


def _cut(rows: DataFrame, text: str, kept: list[str], more, added: str) -> DataFrame:  # noqa: ANN001
    """`kept`, token_index and token for each word of the column `text`, and the columns `added` that more() makes.

    more(batch, codes, bounds, row, start, end): a batch's texts as one array of code points, where each begins, and each word's row and
    places in that array. All of it is array arithmetic: a row's text is gone through once, however many words it has.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, _ = _kinds()
        for b in batches:
            texts = pc.fill_null(b.column(b.schema.get_field_index(text)), "")
            codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
            bounds = np.r_[0, np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)]
            if not len(codes):
                continue
            word, edge = ~space[codes], np.zeros(len(codes) + 1, bool)
            edge[bounds] = True
            first = word & (edge[:-1] | ~np.r_[False, word[:-1]])
            start = np.flatnonzero(first)
            end = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False])) + 1
            before = np.r_[0, np.cumsum(first)][bounds]
            row = np.repeat(np.arange(len(texts)), np.diff(before))
            index = np.arange(len(row)) - before[row]
            size = (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).astype(np.int64)
            ends = np.r_[0, np.cumsum(np.where(word, size, 0))]
            letters = codes[word].tobytes().decode("utf-32-le").encode()
            tokens = pa.StringArray.from_buffers(len(row), pa.py_buffer(np.r_[0, ends[end]].astype(np.int32)), pa.py_buffer(letters))
            at = pa.array(row)
            own = [b.column(b.schema.get_field_index(c)).take(at) for c in kept]
            extra = more(b, codes, bounds, row, start, end)
            yield pa.RecordBatch.from_arrays([*own, pa.array(index.astype(np.int32)), tokens, *extra.values()], [*kept, "token_index", "token", *extra])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema]
    return rows.mapInArrow(cut, ", ".join([*kinds, "token_index int", "token string", added]))


def run_words(runs: DataFrame) -> DataFrame:
    """Words of text runs (document_id, page_number, page_width, page_height, item_index, str, width, height, transform).

    A run's width is dealt to its words by their glyphs, turned by its angle, and projected to fractions of the page whose
    y grows downwards; words without an area go.
    """
    t = lambda i, d: F.coalesce(F.get(F.col("transform"), F.lit(i)), F.lit(d))
    w = F.greatest(F.abs("width"), F.lit(1.0))
    h = F.greatest(F.abs("height"), F.hypot(t(2, 0.0), t(3, 0.0)), F.lit(1.0))
    angle = F.atan2(t(1, 0.0), t(0, 1.0))
    cos, sin = F.cos(angle), F.sin(angle)
    sides = {"page_width": F.col("page_width"), "page_height": F.col("page_height"), "x0": t(4, 0.0), "y0": t(5, 0.0), "wx": cos * w, "wy": sin * w, "hx": sin * h, "hy": cos * h}
    ids = ["document_id", "page_number", "item_index"]
    kept = [*ids, "page_width", "page_height"]

    def dealt(b, codes, bounds, row, start, end) -> dict[str, pa.Array]:  # noqa: ANN001
        total = np.r_[0, np.cumsum(_kinds()[1][codes], dtype=np.int64)]
        whole = np.maximum((total[bounds[row + 1]] - total[bounds[row]]) / 100, 1e-12)
        begin = (total[start] - total[bounds[row]]) / 100 / whole
        stop = begin + (total[end] - total[start]) / 100 / whole
        x0, y0, wx, wy, hx, hy = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[row] for c in ("x0", "y0", "wx", "wy", "hx", "hy"))
        xs, ys = ([at + w * e + k * h for e in (begin, stop) for k in (0, 1)] for at, w, h in ((x0, wx, -hx), (y0, wy, hy)))
        ends = {"__left": (np.minimum, xs), "__right": (np.maximum, xs), "__low": (np.minimum, ys), "__high": (np.maximum, ys)}
        return {name: pa.array(of.reduce(values)) for name, (of, values) in ends.items()}

    pieces = _cut(runs.select(*ids, "str", *(c.alias(k) for k, c in sides.items())), "str", kept, dealt, "__left double, __right double, __low double, __high double")
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    left, right, low, high = (F.col(f"__{c}") for c in ("left", "right", "low", "high"))
    out = pieces.select(*ids, "token_index", F.col("token").alias("text"), F.lit(100.0).alias("confidence"), clamp(left / F.col("page_width")).alias("x"), clamp(1 - high / F.col("page_height")).alias("y"), clamp((right - left) / F.col("page_width")).alias("width"), clamp((high - low) / F.col("page_height")).alias("height"))
    return out.filter("width > 0 AND height > 0")


def line_words(lines: DataFrame) -> DataFrame:
    """Words of recognised lines (text, confidence, x, y, width, height, char_offsets): document_id, page_number, line_index, token_index, text, confidence, box.

    A word ends halfway to its neighbours' centres; at a line's ends, half its own mean character further. Without an offset
    for each character they are spaced evenly.
    """
    kept = ["document_id", "page_number", "line_index", "confidence", "x", "y", "width", "height"]

    def centred(b, codes, bounds, row, start, end) -> dict[str, pa.Array]:  # noqa: ANN001
        a, last, n = start - bounds[row], end - bounds[row] - 1, (bounds[1:] - bounds[:-1])[row]
        centres = b.column(b.schema.get_field_index("char_offsets"))
        missing = (pc.fill_null(pc.list_value_length(centres), -1).to_numpy(zero_copy_only=False) != bounds[1:] - bounds[:-1])[row]
        first = centres.offsets.to_numpy()[row]
        at = lambda i: centres.values.take(pa.array(first + np.clip(i, 0, n - 1), mask=missing))
        ints = {k: pa.array(v) for k, v in (("__first", a), ("__last", last), ("__n", n))}
        return ints | {"__placed": pa.array(~missing), "__before": at(a - 1), "__a": at(a), "__b": at(last), "__after": at(last + 1)}

    added = "__first long, __last long, __n long, __placed boolean, __before double, __a double, __b double, __after double"
    rows = _cut(lines.select(*kept, "text", F.col("char_offsets").cast("array<double>").alias("char_offsets")), "text", kept, centred, added)
    a, b, n, placed, before, at_a, at_b, after = (F.col(c.split()[0]) for c in added.split(", "))
    half = F.greatest((at_b - at_a) / F.greatest(b - a, F.lit(1)), F.lit(0.0)) / 2
    start = F.when(~placed, a / n).when(a > 0, (before + at_a) / 2).otherwise(F.greatest(F.lit(0.0), at_a - half))
    end = F.when(~placed, (b + 1) / n).when(b + 1 < n, (at_b + after) / 2).otherwise(F.least(F.lit(1.0), at_b + half))
    return rows.select("document_id", "page_number", "line_index", "token_index", F.col("token").alias("text"), "confidence", (F.col("x") + F.col("width") * start).alias("x"), "y", F.greatest(F.col("width") * (end - start), F.lit(0.0005)).alias("width"), "height")


def rows_of(boxes: Column) -> Column:
    """Boxes (structs with x, y, width, height, text) as rows, from the top: a row begins where a centre is further from its first box than half the higher of the two."""
    centre = lambda b: b["y"] + b["height"] / 2
    keyed = F.transform(boxes, lambda b, i: F.struct(centre(b).alias("c"), i.alias("i"), b.alias("b")))
    ordered = F.transform(F.array_sort(keyed), lambda k: F.struct(k["c"].alias("c"), F.greatest(k["b"]["height"], F.lit(1e-6)).alias("h"), k["b"].alias("b")))
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("i"), F.lit(0.0).alias("c"), F.lit(0.0).alias("h"))

    def step(a: Column, k: Column) -> Column:
        new = (a["i"] == 0) | (F.abs(k["c"] - a["c"]) > F.greatest(a["h"], k["h"]) / 2)
        return F.struct(F.when(new, F.concat(a["cuts"], F.array(a["i"]))).otherwise(a["cuts"]).alias("cuts"), (a["i"] + 1).alias("i"), F.when(new, k["c"]).otherwise(a["c"]).alias("c"), F.when(new, k["h"]).otherwise(a["h"]).alias("h"))

    # A row's boxes follow one another, so the places where rows begin tell them.
    def rows(o: Column) -> Column:
        cuts = F.aggregate(o, start, step, lambda a: a["cuts"])
        return let(cuts, lambda c: F.transform(c, lambda s, r: F.transform(F.slice(o, s + 1, F.coalesce(F.get(c, r + 1), F.size(o)) - s), lambda z: z["b"])))

    per_row = let(ordered, rows)
    return F.transform(per_row, by_x)


def rows_text(rows: Column) -> Column:
    """Rows of rows_of() as text: trimmed, empty ones left out."""
    from folioscope.functions.text import trimmed

    texts = F.transform(rows, lambda r: F.array_join(F.filter(F.transform(r, lambda b: trimmed(b["text"])), lambda t: t != ""), " "))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


LABELLED = "document_id string, page_number int, pos int, line_id string, place int"


def _labelled(page: pd.DataFrame, reach: float, nearest: bool) -> pd.DataFrame:
    """Words of a page put into lines: the nearest fitting line, or the first."""
    page = page.assign(centre=page.y + page.height / 2).sort_values(["centre", "x", "pos"])
    lines: list[dict] = []
    for r in page.itertuples():
        fit = [(abs(r.centre - ln["centre"]), i) for i, ln in enumerate(lines) if abs(r.centre - ln["centre"]) <= max(r.height, ln["height"]) * reach]
        if fit:
            ln = lines[(min(fit) if nearest else fit[0])[1]]
            ln["words"].append(r)
            ln["centre"] += (r.centre - ln["centre"]) / len(ln["words"])
            ln["height"] = max(ln["height"], r.height)
        else:
            lines.append({"centre": r.centre, "height": r.height, "words": [r]})
    lines.sort(key=lambda ln: ln["centre"] if nearest else (min(w.y for w in ln["words"]), min(w.x for w in ln["words"])))
    out = [(r.document_id, r.page_number, r.pos, f"p{r.page_number}-{i}", k) for i, ln in enumerate(lines) for k, r in enumerate(sorted(ln["words"], key=lambda w: (w.x, w.pos)))]
    return pd.DataFrame(out, columns=[c.split()[0] for c in LABELLED.split(", ")])


def labelled_words(words: DataFrame, reach: float = 0.6, nearest: bool = True) -> DataFrame:
    """LABELLED for words (document_id, page_number, pos, x, y, width, height) without lines; a task holds one page at a time.

    Words come in order of centre, x, pos. reach 0.6 with the nearest line is for text layers; 0.65 with the first for search.
    """
    return words.groupBy("document_id", "page_number").applyInPandas(lambda page: _labelled(page, reach, nearest), LABELLED)


def grouped_lines(words: DataFrame) -> DataFrame:
    """Lines (LINES) of words that have a line_id: one shuffle by page and line."""
    word = F.struct("pos", "text", "confidence", "x", "y", "width", "height")
    lines = words.groupBy("document_id", "page_number", "line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "pos", word.alias("w")))), lambda k: k["w"]).alias("words"), F.min("y").alias("top"))
    page = Window.partitionBy("document_id", "page_number").orderBy("top", F.expr("words[0].x"), "line_id")
    dash = F.coalesce(F.lag(F.expr("words[size(words) - 1].text")).over(page).rlike(r"\p{Pd}\s*$"), F.lit(False))
    return lines.select("document_id", "page_number", (F.row_number().over(page) - 1).alias("line"), "words", dash.alias("after_dash"))


def reading_order(boxes: Column) -> Column:
    """Boxes by y on a grid of 1e-3 (halves to even), then x."""
    return F.transform(F.array_sort(F.transform(boxes, lambda b, i: F.struct(F.bround(b["y"], 3).alias("y"), b["x"].alias("x"), i.alias("i"), b.alias("b")))), lambda k: k["b"])


def ctc_collapsed(steps: DataFrame, alphabet: list[str]) -> DataFrame:
    """text, score, char_offsets of rows with `indices` and `scores` arrays: blanks (0) and repeats go, centres are fractions of the steps."""
    kept = F.filter(F.transform("indices", lambda x, i: F.struct(x.alias("x"), i.alias("i"), F.get(F.col("scores"), i).alias("s"), F.get(F.col("indices"), i - 1).alias("p"))), lambda k: (k["x"] != 0) & ~F.coalesce(k["x"] == k["p"], F.lit(False)))
    letters = F.array(*map(F.lit, alphabet))
    text = F.array_join(F.transform(kept, lambda k: F.get(letters, k["x"] - 1)), "")
    offsets = F.transform(kept, lambda k: (k["i"] + 0.5) / F.size("indices"))
    lead = F.length(text) - F.length(F.ltrim(text))
    score = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, k: a + k["s"]) / F.size(kept)).otherwise(0.0)
    return steps.withColumns({"text": F.trim(text), "score": score, "char_offsets": F.slice(offsets, lead + 1, F.length(F.trim(text)))})


def best_readings(readings: DataFrame, least: float = 0.45) -> DataFrame:
    """Of the readings (document_id, page_number, box_id, text, score, char_offsets, rotated) of each box, that with the best score; offsets of a rotated one are mirrored."""
    best = readings.groupBy("document_id", "page_number", "box_id").agg(F.max_by(F.struct("text", "score", "char_offsets", "rotated"), F.struct("score", "text")).alias("b")).filter(F.col("b.score") >= least)
    offsets = F.when(F.col("b.rotated"), F.reverse(F.transform("b.char_offsets", lambda o: 1 - o))).otherwise(F.col("b.char_offsets"))
    return best.select("document_id", "page_number", "box_id", "b.text", "b.score", offsets.alias("char_offsets"))


def recognized(pages: DataFrame, reader, schema: str) -> DataFrame:  # noqa: ANN001
    """Rows that a recogniser makes of pages: reader() is called once a task and gives a function from a page's row to rows.

    Pages of a document stay together and in order, so that a task opens each file once.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = reader()
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            yield pd.DataFrame([row for page in batch.to_dict("records") for row in one(page)], columns=names)

    return pages.repartition("document_id").sortWithinPartitions("document_id", "page_number").mapInPandas(read, schema)
