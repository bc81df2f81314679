import hashlib

import pytest

from folioscope.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, key int"


def plain(rows, least=100):
    payloads = [(r[2] or "").encode() for r in rows]
    out = []
    for r, p in zip(rows, payloads, strict=True):
        ids = [x[0] for x, q in zip(rows, payloads, strict=True) if q == p and x[0] is not None]
        first = min(ids) if len(p) >= least and ids else r[0]
        revisit = first != r[0]
        out.append((r[0], "revisit" if revisit else "response", first if revisit else None, len(p), hashlib.sha256(p).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in df.collect()), key=str)


def test_round_trip(spark):
    odd = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9
    rows = [(5, "http://a/x", "same" * 40, "d", 1), (2, None, "same" * 40, None, None), (9, "http://b/ \r\nq", "same" * 40, "", 2), (None, "http://n", "same" * 40, "", 2)]
    rows += [(1, "u", "short", "", 0), (0, "u", "short", "", 0), (3, "u", None, "", 0), (4, "u", "", "", 0), (6, "u", odd, "", 0), (7, "u", odd, "", 0), (8, "é", "üé😀" * 90, "", 0), (10, "v", "long " * 400_000, "", 0), (11, "w", "q" * 99, "", 0), (12, "w", "q" * 99, "", 0), (13, "w", "q" * 100, "", 0), (14, "w", "q" * 100, "", 0)]
    rows += [(None, "x", "z" * 200, "", 0), (None, "y", "z" * 200, "", 0), (2, None, "same" * 40, None, None)]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert got(warc.round_trip(pages)) == plain(rows)
    assert got(warc.round_trip(pages.limit(0))) == []


def test_archives_are_small_compressed_and_checked(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"{i % 7} " * 500) for i in range(100)], "page_id long, url string, html string")
    path = f"{tmp_path}/w"
    warc.write_archives(pages.coalesce(1), path, archive_bytes=20_000, compression="gzip")
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    assert len(files) > 3 and all(p.name.endswith(".gz") for p in files)
    heads = warc.read_archives(spark, path)
    assert got(warc.revisits_resolved(heads)) == plain([(r.page_id, r.url, r.html) for r in pages.collect()])
    ids = [r.record_id for r in heads.collect()]
    assert len(set(ids)) == 100


def test_changed_payload_is_refused():
    head = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc.parsed(head.encode()))


def test_binary_payload_survives(spark):
    raw = bytes(range(256)) * 3
    pages = spark.createDataFrame([(1, "u", raw), (2, "u", raw)], "page_id long, url string, html binary")
    assert {r[4] for r in got(warc.round_trip(pages))} == {hashlib.sha256(raw).hexdigest()}


def test_beyond_the_broadcast_only_marked_payloads_move(spark):
    rows = [(i, f"http://h/{i}", f"{i % 40} payload " * 30 if i % 3 else f"{i} alone " * 30) for i in range(300)] + [(None, "n", "1 payload " * 30), (400, "s", "short"), (401, "s", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    few, many = (sorted(map(tuple, warc.resolved(pages, repeated_rows=n).select("page_id", "uri", "payload", "bytes", "digest", "first.page_id", "first.uri").collect()), key=str) for n in (500, 0))
    assert few == many and len(few) == len(rows) and sum(r[2] is None for r in few) > 100
    marked = warc._may_repeat(warc._digested(pages), warc._digested(pages).filter("page_id = 7").select("digest"))
    assert {r.page_id for r in marked.filter("maybe").collect()} == {r[0] for r in rows if r[2] == rows[7][2]}


def test_long_headers_and_other_records_are_read(spark, tmp_path):
    def record(kind, block, more=""):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{kind}>\r\nWARC-Target-URI: u\r\n{more}Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"

    (tmp_path / "part-0.warc").write_text(record("warcinfo", "software: x\r\n") + record("response", "HTTP/1.1 200 OK\r\nX: " + "y" * 20_000 + "\r\n\r\nbody"), newline="")
    (row,) = warc.read_archives(spark, str(tmp_path)).collect()
    assert (row.record_type, row.payload_bytes, row.payload_digest) == ("response", 4, hashlib.sha256(b"body").hexdigest())
