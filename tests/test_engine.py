import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioscope import schema
from folioscope.operators import findings, keywords, layout, quality, queue, search, status
from folioscope.sources import media

NOW = "2024-02-01 00:00:00"


def now():
    return F.to_timestamp_ntz(F.lit(NOW))


def line(number, texts, gap=0.01, height=0.02, y=None, after_dash=False, document="d", page=1, x=0.05):
    words = []
    for i, t in enumerate(texts):
        w = 0.01 * len(t)
        words.append((100 * number + i, t, 90.0, x, 0.1 + 0.05 * number if y is None else y, w, height))
        x += w + (gap[i] if isinstance(gap, list) else gap)
    return (document, page, number, words, after_dash)


def lines_of(spark, rows):
    return spark.createDataFrame(rows, schema.LINES)


def keys(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "keyword_id long, keyword string")


def found(spark, rows, *texts):
    return sorted((r.keyword, r.line, r.start_at, r.n_words) for r in search.search(lines_of(spark, rows), keys(spark, *texts)).collect())


def test_whole_words(spark):
    assert found(spark, [line(0, ["azal", "azaltmaq"])], "azal") == [("azal", 0, 0, 1)]
    assert found(spark, [line(0, ["azal", "dilmasi"], gap=0.001)], "azal", "azaldilmasi") == [("azaldilmasi", 0, 0, 2)]
    assert found(spark, [line(0, ["x", "azal-"]), line(1, ["dilmasi", "y"], after_dash=True)], "azal", "dilmasi") == []
    assert found(spark, [line(0, ["şə", "bə", "kə", "lər", "dən"])], "şəbəkələrdən") == [("şəbəkələrdən", 0, 0, 5)]
    assert found(spark, [line(0, ["aaaa"])], "aa") == []
    assert found(spark, [line(0, ["aa", "aa", "aa"])], "aa aa") == [("aa aa", 0, 0, 2)]
    assert found(spark, [line(0, ["Bank", "--", "Of"])], "bank of", "BANK", "bank", "--") == [("BANK", 0, 0, 1), ("bank", 0, 0, 1), ("bank of", 0, 0, 2)]
    assert found(spark, [line(0, ["a"])], "--") == []


def plain_matches(words, flags, needle):
    norm = ["".join(c for c in unicodedata.normalize("NFKD", w.lower()) if c.isalnum()) for w in words]
    text, owner, starts, ends = "".join(norm), [], set(), set()
    for i, n in enumerate(norm):
        if n:
            starts.add(len(owner))
            owner += [i] * len(n)
            ends.add(len(owner) - 1)
    at, out = 0, []
    while (at := text.find(needle, at)) >= 0:
        end = at + len(needle) - 1
        if at in starts and end in ends and not flags[owner[at]] and not flags[owner[end] + 1]:
            out.append((at, len(set(owner[at : end + 1]))))
            at = end + 1
        else:
            at += 1
    return out


def test_scan_equals_a_plain_one(spark):
    rng = random.Random(6)
    rows, want = [], []
    needles = ["a", "ab", "ba", "aba", "bb", "abab"]
    for n in range(150):
        words = [rng.choice(["a", "b", "ab", "ba", "-", "aab", "b."]) for _ in range(rng.randint(1, 8))]
        gaps = [rng.choice([0.01, 0.0005]) for _ in words]
        rows.append((f"d{n}", 1, 0, line(0, words, gaps)[3], False))
        glued = [False] + [g < 0.0016 for g in gaps[:-1]] + [False]
        want += [(f"d{n}", k, *m) for k in needles for m in plain_matches(words, glued, k)]
    lines = lines_of(spark, rows)
    wanted = keys(spark, *needles)
    for got in (search.search(lines, wanted), search.search(lines, wanted, small=0)):
        assert sorted((r.document_id, r.keyword, r.start_at, r.n_words) for r in got.collect()) == sorted(want)


def test_boxes_hold_their_words(spark):
    r = search.search(lines_of(spark, [line(0, ["one", "two", "three"])]), keys(spark, "two three")).first()
    assert (r.x, r.width) == (pytest.approx(0.05 + 0.03 + 0.01), pytest.approx(0.03 + 0.01 + 0.05)) and r.height == pytest.approx(0.02)


def test_candidate_pages(spark):
    pages = spark.createDataFrame([("a", "COMPLETE", "xbanky"), ("b", "COMPLETE", ""), ("c", "COMPLETE", "none"), ("d", "PENDING", "bank")], "document_id string, status string, search_text string")
    assert {r.document_id for r in search.candidate_pages(pages, keys(spark, "Bank")).collect()} == {"a", "b"}
    many = keys(spark, "Bank", "q", *(f"zz{i}" for i in range(300)))
    assert {r.document_id for r in search.candidate_pages(pages, many).collect()} == {"a", "b"}


def test_trigrams_equal_the_plain_way(spark):
    rng = random.Random(8)
    rows = [(f"d{n % 40}", n // 40, "COMPLETE", "".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 9, 60]))) if n % 50 else None) for n in range(400)]
    pages = spark.createDataFrame(rows, "document_id string, page_number int, status string, search_text string")
    needles = ["c", "abc", "abcabc", "bbbbb", "cabac", "xyz", "abx"]
    wanted = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = {(r.document_id, r.page_number) for r in search._by_trigrams(pages, wanted.filter("needle <> 'c'")).collect()}
    assert got == {r[:2] for r in rows if r[3] is not None and (not r[3] or any(n in r[3] for n in needles[1:]))}
    assert {(r.document_id, r.page_number) for r in search._by_trigrams(pages, wanted).collect()} == {r[:2] for r in rows if r[3] is not None and (not r[3] or any(n in r[3] for n in needles))}


def test_places_are_numbered_by_ranges(spark):
    rows = [(i, seq) for i, seq in enumerate([5, None, 1 << 21, (1 << 21) + 1, 1 << 40, 3, 3, -7, (1 << 20) - 1, 1 << 20])]
    got = queue.numbered(spark.createDataFrame(rows, "document_id int, upload_seq long"), "place", rows=3).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [r.document_id for r in sorted(got, key=lambda r: r.place)] == [r[0] for r in want] and sorted(r.place for r in got) == list(range(1, 11))


def test_stored_highlights(spark):
    stored = spark.createDataFrame([("d", "MANUAL", "m"), ("d", "AUTO", "old"), ("e", "AUTO", "old")], "document_id string, source string, keyword string")
    new = spark.createDataFrame([("d", "AUTO", "new"), ("e", "AUTO", "late")], stored.schema)
    ids = spark.createDataFrame([("d",)], "document_id string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(search.replace_auto(stored, new, ids)) == {("d", "MANUAL", "m"), ("d", "AUTO", "new"), ("e", "AUTO", "old")}
    assert rows(search.replace_all(stored, new, ids)) == {("d", "AUTO", "new"), ("e", "AUTO", "old")}
    assert rows(search.delete_auto(stored, ids)) == {("d", "MANUAL", "m"), ("e", "AUTO", "old")}
    docs = spark.createDataFrame([("d", "COMPLETE"), ("p", "PENDING")], "document_id string, ocr_status string")
    asked = spark.createDataFrame([("d",), ("p",), ("u",)], "document_id string")
    assert rows(search.searched_documents(docs, asked, keys(spark, "x"), new)) == {("d", 1)}
    assert rows(search.searched_documents(docs, asked, keys(spark, "--"), new)) == {("d", 0), ("p", 0), ("u", 0)}


def test_lines(spark):
    df = lines_of(spark, [line(0, ["a", "b", "c"], gap=[0.001, 0.2, 0])])
    r = df.select(layout.raw_line_text(F.col("words")).alias("t"), F.transform(layout.segments(F.col("words")), lambda s: F.size(s)).alias("s")).first()
    assert r.t == "ab c" and r.s == [2, 1]
    words = df.select("document_id", "page_number", F.explode("words").alias("w")).select("document_id", "page_number", "w.*")
    other = lines_of(spark, [line(1, ["d", "e"])]).select("document_id", "page_number", F.explode("words").alias("w")).select("document_id", "page_number", "w.*")
    both = words.union(other)
    labels = layout.labelled_words(both)
    assert {(r.pos, r.line_id, r.place) for r in labels.collect()} == {(0, "p1-0", 0), (1, "p1-0", 1), (2, "p1-0", 2), (100, "p1-1", 0), (101, "p1-1", 1)}
    again = layout.grouped_lines(both.join(labels, ["document_id", "page_number", "pos"])).orderBy("line").collect()
    assert [[w.text for w in r.words] for r in again] == [["a", "b", "c"], ["d", "e"]]


def test_rows_and_recognised_lines(spark):
    boxes = [("b", 0.5, 0.101, 0.1, 0.02), ("a", 0.1, 0.1, 0.1, 0.02), (" ", 0.3, 0.2, 0.1, 0.02), ("c", 0.2, 0.3, 0.1, 0.02)]
    df = spark.createDataFrame([(boxes,), ([],)], "boxes array<struct<text:string,x:double,y:double,width:double,height:double>>")
    assert [r.t for r in df.select(layout.rows_text(layout.rows_of(F.col("boxes"))).alias("t")).collect()] == ["a b\nc", ""]
    lines = spark.createDataFrame([("d", 1, 0, "ab c", 90.0, 0.0, 0.1, 1.0, 0.02, [0.1, 0.3, 0.5, 0.9])], "document_id string, page_number int, line_index int, text string, confidence double, x double, y double, width double, height double, char_offsets array<double>")
    got = [(r.text, round(r.x, 6), round(r.width, 6)) for r in layout.line_words(lines).orderBy("token_index").collect()]
    assert got == [("ab", 0.0, 0.4), ("c", 0.7, 0.2)]
    steps = spark.createDataFrame([([0, 1, 1, 0, 1, 3], [0.0, 0.9, 0.8, 0.0, 0.6, 0.3])], "indices array<int>, scores array<double>")
    r = layout.ctc_collapsed(steps, ["a", "b", " "]).first()
    assert (r.text, r.score) == ("aa", pytest.approx(0.6)) and r.char_offsets == [pytest.approx(1.5 / 6), pytest.approx(4.5 / 6)]
    readings = spark.createDataFrame([("d", 1, 0, "x", 0.5, [0.1, 0.2], False), ("d", 1, 0, "y", 0.9, [0.1, 0.2], True), ("d", 1, 1, "z", 0.3, [0.1], False)], "document_id string, page_number int, box_id int, text string, score double, char_offsets array<double>, rotated boolean")
    assert [(r.text, [round(o, 6) for o in r.char_offsets]) for r in layout.best_readings(readings).collect()] == [("y", [0.8, 0.9])]


def test_page_quality(spark):
    words = ["plain"] * 50
    pages = {"good": words, "short": ["a"] * 6, "broken": ["plAin"] * 3 + words, "split": ["ab"] * 60, "private": ["abc"] * 50, "url": ["www.aB.com"] * 45 + words}
    rows = [(k, 1, [(i, t, 90.0, 0.1, 0.1, 0.1, 0.02) for i, t in enumerate(v)]) for k, v in pages.items()]
    df = spark.createDataFrame(rows, f"document_id string, page_number int, words array<{schema.WORD}>")
    got = {r.document_id: r for r in quality.judged_pages(df).collect()}
    assert {k: r.reason for k, r in got.items()} == {"good": None, "short": "characters", "broken": "broken encoding", "split": "fragmented", "private": "unreadable", "url": None}
    assert got["broken"].broken == pytest.approx(3 / 53) and got["short"].fragmented is None and got["split"].fragmented == 1
    swept = spark.createDataFrame([("d", 1, "pdf-text", "COMPLETE", 0.03, None), ("d", 2, "pdf-text", "COMPLETE", 0.0, 0.6), ("e", 1, "pdf-text", "COMPLETE", 0.0, 0.6), ("e", 2, "pdf-text", "COMPLETE", 0.0, 0.1), ("e", 3, "pending", "PENDING", 0.0, 0.1)], "document_id string, page_number int, source string, status string, broken double, fragmented double")
    assert {(r.document_id, r.page_number): r.requeue for r in quality.swept(swept).collect()} == {("d", 1): "encoding", ("d", 2): "fragments", ("e", 1): "fragments", ("e", 2): "fragments", ("e", 3): None}


def test_queue(spark):
    job = "document_id long, page_number long, status string, attempts int, started_at timestamp_ntz, error string"
    old, new = "2024-01-31 23:49:00", "2024-01-31 23:55:00"
    rows = [(1, 1, "PROCESSING", 1, old, None), (1, 2, "PROCESSING", 3, old, None), (1, 3, "PROCESSING", 1, new, None), (1, 4, "PENDING", 3, None, None), (1, 5, "COMPLETE", 3, old, None)]
    pages = spark.createDataFrame(rows, "document_id long, page_number long, status string, attempts int, started_at string, error string").withColumn("started_at", F.to_timestamp_ntz("started_at"))
    assert job
    swept = queue.release_stale(pages, now())
    assert {r.page_number: (r.status, r.changed) for r in swept.collect()} == {1: ("PENDING", True), 2: ("FAILED", True), 3: ("PROCESSING", False), 4: ("FAILED", True), 5: ("COMPLETE", False)}
    assert {r.status for r in queue.release_stale(swept.drop("changed"), now()).collect() if r.changed} == set()
    back = queue.release(pages, pages.select("document_id", "page_number"))
    assert {r.page_number: (r.status, r.attempts) for r in back.collect()}[1] == ("PENDING", 0) and {r.page_number: r.attempts for r in back.collect()}[4] == 3
    done = spark.createDataFrame([(1, 3, "t"), (9, 9, "gone")], "document_id long, page_number long, text string")
    assert {(r.page_number, r.status, r.text) for r in queue.complete(pages, done).collect() if r.text} == {(3, "COMPLETE", "t")}


def test_status_roll_up(spark):
    rows = [("cc", 1, "C"), ("cc", 2, "C"), ("cf", 1, "C"), ("cf", 2, "F"), ("ff", 1, "F"), ("cp", 1, "C"), ("cp", 2, "P")]
    full = {"C": "COMPLETE", "F": "FAILED", "P": "PENDING"}
    pages = spark.createDataFrame([(d, n, full[s], "bad" if s == "F" else None) for d, n, s in rows], "document_id string, page_number int, status string, error string")
    got = {r.document_id: (r.status, r.page_count, r.ocr_error) for r in status.document_status(pages).collect()}
    assert got == {"cc": ("COMPLETE", 2, None), "cf": ("COMPLETE", 2, "1 of 2 pages could not be read (first was page 2: bad)."), "ff": ("FAILED", 1, "1 of 1 page could not be read (first was page 1: bad)."), "cp": ("PROCESSING", None, None)}


def test_transcript(spark):
    pages = spark.createDataFrame([("v", 1, "Hello  World\nb", "COMPLETE"), ("v", 2, "hello world\r\nc ", "COMPLETE"), ("v", 3, "B", "COMPLETE")], "document_id string, page_number int, text string, status string")
    got = {r.page_number: (r.timestamp_s, r.text) for r in status.text_segments(pages, F.lit(2.0), video=True).collect()}
    assert got == {1: (0.0, "Hello  World\nb"), 2: (2.0, "c"), 3: (4.0, "")}


def test_keywords(spark):
    k = spark.createDataFrame([(1, " Bank"), (2, "bank"), (3, " ")], "id int, name string")
    links = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (1, 9)], "keyword_id int, source_type_id int")
    projects = spark.createDataFrame([(1, 7), (2, 7), (2, 9)], "keyword_id int, project_id int")
    rows = keywords.keywords_for_source(k, links, projects)
    assert sorted(map(tuple, rows.collect())) == [(1, "Bank", [7]), (2, "bank", [7, 9])]
    assert [tuple(r) for r in keywords.without_repeats(rows).collect()] == [(1, "Bank", [7, 9])]
    with pytest.raises(ValueError):
        keywords.published(0, ["why"])
    with pytest.raises(ValueError):
        keywords.guarded_sql(spark, "drop table x")
    assert keywords.guarded_sql(spark, "select 1 as a").first().a == 1
    assert keywords.resolved_column(k) == "name" and keywords.is_textual(k, "name") and not keywords.is_textual(k, "id")


def test_findings(spark):
    rows = [line(0, ["running", "head"], y=0.01), line(1, ["BIG", "TITLE"], height=0.04, y=0.2), line(2, ["goes", "on"], height=0.04, y=0.25), line(3, ["some", "bank", "news"], y=0.32), line(4, ["more", "text"], y=0.36), line(5, ["far", "away"], y=0.4)]
    lines = lines_of(spark, rows)
    h = findings.with_ids(search.search(lines, keys(spark, "bank")))
    docs = spark.createDataFrame([("d", "A.pdf")], "document_id string, original_name string")
    r = findings.findings(h, lines, docs).first()
    assert (r.file_name, r.title, r.matched_text, r.context, r.confidence) == ("A.pdf", "BIG TITLE goes on", "bank", "goes on some bank news more text", 90.0)


def test_media(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20" + b"\x00" * 12
    df = spark.createDataFrame([(bytearray(jpeg),), (bytearray(b"no"),), (None,)], "content binary")
    assert [tuple(r.s) for r in df.coalesce(1).select(media.jpeg_size("content").alias("s")).collect()] == [(16, 32), (None, None), (None, None)]
    names = spark.createDataFrame([("a.PDF", ""), ("a.mp4", "image/png"), ("x", "image/png"), (".pdf", ""), ("x.txt", "text/plain")], "n string, m string")
    assert [tuple(r) for r in names.coalesce(1).select(media.accepted(F.col("n"), F.col("m")), media.kind(F.col("n"), F.col("m"))).collect()] == [(True, "document"), (True, "video"), (True, "image"), (False, "document"), (False, "document")]


def test_requests():
    assert schema.checked_request(["a"], [" x "]) == (["a"], ["x"])
    for ids, words in (([], ["x"]), (["a"], [" "]), (["a"] * 501, ["x"]), (["a"], ["x" * 251])):
        with pytest.raises(ValueError):
            schema.checked_request(ids, words)
