"""DuckDB SQL for the catalogue: the rows that each query must give."""

from __future__ import annotations

from folioscope.functions.encoding import BYTE_FONT, CYRILLIC_FONT
from folioscope.functions.glyphs import WIDTHS
from folioscope.functions.text import MOJIBAKE
from folioscope.operators.keywords import FORBIDDEN
from folioscope.operators.queue import LOST, SPENT
from folioscope.sources.media import DOCUMENT_TYPES, IMAGE, OFFICE, VIDEO

WS = r"\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
TOKEN = r"[^\x20\x09-\x0D]+"
STATEMENTS = ("SELECT 1", "with t as (select 1) select * from t", "INSERT INTO t VALUES (1)", "delete from t", "select 1; drop table t", "-- note\n select updated from t", "/* a */ select replace(x) from t", "selected", "explain select 1", "select deleted from t /* update */")
EXTENSIONS = (".pdf", ".DOCX", ".jpg", ".mp4", ".txt", "", ".tar.gz", ".Png", ".mkv")
MIMES = ("application/pdf", "text/plain", "image/x-own", "video/x-own", "application/rtf", "application/octet-stream", "text/html")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(xs) -> str:  # noqa: ANN001
    return "(" + ", ".join(map(quoted, xs)) + ")"


def token_sql(c: str) -> str:
    flat = f"regexp_replace(translate(strip_accents(lower({c})), 'ıə', 'i'), '\\p{{Lm}}+', '', 'g')"
    return rf"regexp_replace({flat}, '^[^\p{{L}}\p{{N}}\p{{Pd}}]+|[^\p{{L}}\p{{N}}\p{{Pd}}]+$', '', 'g')"


def search_sql(c: str) -> str:
    return rf"regexp_replace({token_sql(c)}, '[^\p{{L}}\p{{N}}]+', '', 'g')"


_single = {k: v for k, v in CYRILLIC_FONT.items() if len(v) == 1}


def has_bytes(c: str) -> str:
    n = f"length(regexp_replace({c}, '[^À-Õ×-ÿ]', '', 'g'))"
    return f"({n} >= 3 AND {n}::DOUBLE / greatest(length(regexp_replace({c}, '[{WS}]', '', 'g')), 1) >= 0.12)"


def has_cyrillic(c: str) -> str:
    n, m = (f"length(regexp_replace({c}, '[^{x}]', '', 'g'))" for x in (r"\x{0400}-\x{04FF}", "".join(CYRILLIC_FONT)))
    return f"({n} >= 3 AND {m}::DOUBLE / greatest({n}, 1) >= 0.9)"


def decoded(c: str) -> str:
    cyr = lambda x: f"replace(replace(translate({x}, '{''.join(_single)}', '{''.join(_single.values())}'), 'ю', 'yu'), 'Ю', 'Yu')"
    return f"CASE WHEN {has_bytes(c)} THEN {cyr(f'translate({c}, {quoted(chr(0).join(()) + str().join(BYTE_FONT))}, {quoted(str().join(BYTE_FONT.values()))})')} WHEN {has_cyrillic(c)} THEN {cyr(c)} ELSE {c} END"


def cleaned(c: str, most: int = 4000) -> str:
    out = f"({decoded(c)})"
    for a, b in MOJIBAKE:
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    out = rf"regexp_replace({out}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{{E000}}-\x{{F8FF}}\x{{FFFD}}]', ' ', 'g')"
    return f"substr(trim(regexp_replace({out}, '[{WS}]+', ' ', 'g')), 1, {most})"


def width(c: str) -> str:
    """The width of one character."""
    return "CASE " + " ".join(f"WHEN {c} IN {among(cs)} THEN {w}::DOUBLE" for w, cs in WIDTHS.items()) + rf" WHEN regexp_matches({c}, '^[0-9]$') THEN 0.64::DOUBLE WHEN regexp_matches({c}, '\p{{Lu}}') THEN 0.70::DOUBLE ELSE 0.61::DOUBLE END"


def words(damage: bool = False) -> str:
    """Common tables toks and words."""
    t = "text"
    if damage:
        t = "CASE WHEN doc_id % 7 = 0 AND pos % 10 = 0 AND length(text) >= 3 THEN substr(text, 1, 2) || 'X' || substr(text, 4) ELSE text END"
        t = f"CASE WHEN doc_id % 11 = 0 THEN substr({t}, 1, 2) ELSE {t} END"
        t = f"CASE WHEN doc_id % 5 = 0 AND pos % 9 = 0 THEN {t} || chr(57344) ELSE {t} END"
    return f"""raw AS (SELECT doc_id, unnest(t) AS text, unnest(range(len(t))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS t FROM documents)),
toks AS (SELECT doc_id, pos, {t} AS text FROM raw),
words AS (SELECT doc_id, doc_id::VARCHAR AS document_id, (pos // 240 + 1)::INT AS page_number, (pos % 240 // 12)::INT AS line, (pos % 12)::INT AS i, pos::INT AS pos, text, (100 - pos % 40)::DOUBLE AS confidence,
  least(1.0::DOUBLE, (coalesce(sum(length(text)) OVER (PARTITION BY doc_id, pos // 12 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 15
    + pos % 12 * 50 + CASE WHEN pos % 12 >= 6 AND doc_id % 2 = 0 THEN 800 ELSE 0 END)::DOUBLE / 10000::DOUBLE) AS x,
  (pos % 240 // 12 * 450 + 400)::DOUBLE / 10000::DOUBLE AS y, least(1.0::DOUBLE, (length(text) * 15)::DOUBLE / 10000::DOUBLE) AS width,
  CASE WHEN pos % 240 // 12 IN (0, 10) THEN 0.03::DOUBLE ELSE 0.02::DOUBLE END AS height FROM toks)"""


NORMALIZE_TOKEN = f"SELECT doc_id, md5({token_sql('text')}) AS token_md5 FROM documents"
NORMALIZE_SEARCH = f"SELECT doc_id, length({search_sql('text')})::INT AS n, md5({search_sql('text')}) AS search_md5 FROM documents"
CLEAN_REPORT_TEXT = f"SELECT doc_id, length(c)::INT AS n, md5(c) AS text_md5 FROM (SELECT doc_id, {cleaned('text')} AS c FROM documents)"
_slug = r"regexp_replace(regexp_replace(lower(translate(strip_accents(s), 'əƏıİğĞşŞçÇöÖüÜ', 'eeiigGsScCoOuU')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
SLUGIFY_SOURCE = f"""WITH t AS (SELECT 'd' || doc_id AS k, text AS s FROM documents UNION ALL SELECT 'p' || p_partkey, p_name FROM part)
SELECT k, coalesce(nullif(regexp_replace(substr({_slug}, 1, 60), '-+$', ''), ''), 'item') AS slug FROM t"""
FALLBACK_TITLE = rf"""WITH l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS k FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS a FROM documents)),
c AS (SELECT doc_id, k, {cleaned('line', 250)} AS title FROM l), f AS (SELECT doc_id, arg_min(title, k) AS title FROM c WHERE length(title) >= 3 AND regexp_matches(title, '\p{{L}}') GROUP BY doc_id)
SELECT d.doc_id, coalesce(f.title, '') AS title FROM documents d LEFT JOIN f USING (doc_id)"""
UNREADABLE_RATIO = rf"""WITH {words(True)}, r AS (SELECT doc_id, sum(length(text))::DOUBLE AS n, sum(length(regexp_replace(text, '[\x{{FFFD}}\x{{E000}}-\x{{F8FF}}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')))::DOUBLE AS m FROM toks GROUP BY doc_id)
SELECT d.doc_id, round(CASE WHEN n > 0 THEN (n - m) / n ELSE 0 END, 6)::DOUBLE AS ratio FROM documents d LEFT JOIN r USING (doc_id)"""
LEGACY_DETECT = f"SELECT doc_id, {has_bytes('text')} AS byte_font, {has_bytes('text')} OR {has_cyrillic('text')} AS cyrillic_font FROM documents"
LEGACY_DECODE = f"SELECT doc_id, md5({decoded('text')}) AS text_md5 FROM documents"
LANGUAGE_PARSE = """WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || '+AZ' WHEN 1 THEN 'tur, ru' ELSE 'uz+eng+uzb' END AS told, lang FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN lang = 'en' THEN 'aze+eng' END WHEN 1 THEN 'rus+tur' ELSE 'eng+uzb' END AS languages,
  CASE doc_id % 3 WHEN 1 THEN 'cyrillic+latin' ELSE 'latin' END AS scripts FROM t"""
FILE_NAME_PARSE = """WITH t AS (SELECT doc_id, source, doc_id % 31 + 1 AS d, doc_id % 12 + 1 AS m, doc_id % 4 AS k FROM documents),
u AS (SELECT *, CASE WHEN k <> 2 THEN try_strptime(d || '.' || m || '.2024', '%d.%m.%Y')::DATE END AS day FROM t)
SELECT doc_id,
  CASE WHEN k = 2 THEN source || ' notes' WHEN k = 3 AND day IS NOT NULL THEN source WHEN k = 3 THEN lpad(d::VARCHAR, 2, '0') || '-' || lpad(m::VARCHAR, 2, '0') || '.2024 ' || source
    WHEN day IS NOT NULL THEN 'My ' || source ELSE 'My ' || source || ' ' || lpad(d::VARCHAR, 2, '0') || '.' || lpad(m::VARCHAR, 2, '0') || '.2024' END AS author,
  strftime(coalesce(day, DATE '2024-01-31'), '%d.%m.%Y') AS date_text, strftime(coalesce(day, DATE '2024-01-31'), '%Y-%m-%d') AS iso_date, day IS NOT NULL AS from_name,
  CASE WHEN k = 2 THEN source || '_notes.pdf' WHEN k = 3 THEN lpad(d::VARCHAR, 2, '0') || '-' || lpad(m::VARCHAR, 2, '0') || '.2024 ' || source || '.pdf'
    ELSE 'My_' || source || '_' || lpad(d::VARCHAR, 2, '0') || '.' || lpad(m::VARCHAR, 2, '0') || '.2024.pdf' END AS viewer_name FROM u"""
TOKENISE_WORDS = f"""WITH {words()}, chosen AS (SELECT * FROM words),
chars AS (SELECT document_id, page_number, line, i, text, unnest(string_split(text, '')) AS c FROM chosen),
wide AS (SELECT document_id, page_number, line, i, text, sum({width('c')}) AS w FROM chars GROUP BY ALL),
runs AS (SELECT *, sum(w) OVER l + 0.32::DOUBLE * i - w AS a, sum(w) OVER l + 0.32::DOUBLE * i AS b, sum(w) OVER (PARTITION BY document_id, page_number, line) + 0.32::DOUBLE * max(i) OVER (PARTITION BY document_id, page_number, line) AS total
  FROM wide WINDOW l AS (PARTITION BY document_id, page_number, line ORDER BY i))
SELECT document_id, page_number, line AS item_index, i AS token_index, text, round((50 + 500 * a / total) / 600 + 1e-9::DOUBLE, 6) AS x, round(1 - (700 - line * 20 + 10)::DOUBLE / 800 + 1e-9::DOUBLE, 6) AS y,
  round(500 * (b - a) / total / 600 + 1e-9::DOUBLE, 6) AS width, round(10::DOUBLE / 800 + 1e-9::DOUBLE, 6) AS height FROM runs"""
GLYPH_PREFIX = f"""WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c, unnest(range(length(p_name))) AS k FROM part), w AS (SELECT p_partkey, k, {width('c')} AS w FROM c)
SELECT p_partkey, round(sum(w), 6) AS width, round(sum(w) FILTER (k < 3), 6) AS first_three, round(sum(w) FILTER (k < 2) / 2, 6) AS gap FROM w GROUP BY p_partkey"""
LINE_TEXT = f"WITH {words()} SELECT document_id, page_number, line, string_agg(text, ' ' ORDER BY x, i) AS text FROM words GROUP BY ALL"
LINE_BOXES = f"WITH {words()} SELECT document_id, page_number, line, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x + width) - min(x), 6) AS width, round(max(y + height) - min(y), 6) AS height FROM words GROUP BY document_id, page_number, line"
GUTTER_SEGMENTS = f"""WITH {words()}, g AS (SELECT *, CASE WHEN x - lag(x + width) OVER l > greatest(avg(height) OVER (PARTITION BY document_id, page_number, line) * 2.5, 0.02) THEN 1 ELSE 0 END AS cut FROM words WINDOW l AS (PARTITION BY document_id, page_number, line ORDER BY x, i)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY document_id, page_number, line ORDER BY x, i)::INT AS segment FROM g)
SELECT document_id, page_number, line, segment, count(*)::INT AS n_words, string_agg(text, ' ' ORDER BY x, i) AS text FROM s GROUP BY document_id, page_number, line, segment"""
COMPACT_WORDS = f"""WITH {words()}, f AS (SELECT *, x / 3 AS x3 FROM words)
SELECT document_id, page_number, line, floor(first(x3) OVER l * 1e5 + 0.5) / 1e5 <> first(x3) OVER l AS needed, 'w' || i AS id, floor(confidence - 0.5 + 0.5)::INT AS confidence, round(floor(x3 * 1e5 + 0.5) / 1e5, 6) AS x, 'l' || (i % 2) AS line_id
FROM f WINDOW l AS (PARTITION BY document_id, page_number, line ORDER BY i)"""
LINE_WORDS = f"""WITH {words()}, f AS (SELECT *, length(text) AS n, sum(length(text)) OVER (PARTITION BY document_id, page_number, line ORDER BY i) + i - length(text) AS a, sum(length(text)) OVER (PARTITION BY document_id, page_number, line) + max(i) OVER (PARTITION BY document_id, page_number, line) AS total
  FROM words), e AS (SELECT *, (a + n)::DOUBLE AS b FROM f),
g AS (SELECT *, CASE WHEN line > 0 OR a > 0 OR n > 1 THEN a / total ELSE 0.5 / total END AS s, CASE WHEN line > 0 OR b < total OR n > 1 THEN b / total ELSE (b - 0.5) / total END AS t FROM e)
SELECT document_id, page_number, line AS line_index, i AS token_index, text, round(0.1 + 0.8 * s, 6) AS x, round(greatest(0.8 * (t - s), 0.0005), 6) AS width FROM g"""

ROW_GROUPING = f"""WITH {words()}, t AS (SELECT *, regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g') AS s FROM words),
r AS (SELECT document_id, page_number, line, coalesce(string_agg(s, ' ' ORDER BY x, pos % 3, pos) FILTER (s <> ''), '') AS s FROM t GROUP BY ALL)
SELECT document_id, page_number, count(*)::INT AS n_rows, coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (s <> ''), '') AS text FROM r GROUP BY document_id, page_number"""
CTC_COLLAPSE = """SELECT p_partkey, trim(x) AS text, CASE WHEN x <> '' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS score, length(trim(x))::INT AS n_offsets
FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z ]', '', 'g') AS x FROM part)"""

_judged = rf"length(text) > 1 AND NOT regexp_matches(text, '(?i)^(https?:|www\.)|\.(az|com|org|net|ru|tr)($|[^0-9A-Za-z_])') AND NOT regexp_matches(text, '^(\p{{Lu}}\.){{1,3}}\p{{Lu}}')"
_suspect = r"regexp_matches(text, '\p{Ll}[A-Z]|\p{L}[0-9]\p{L}')"
_size = r"length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))"
_unread = r"length(regexp_replace(text, '[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'))"
_PAGES = f"""{words(True)}, stats AS (SELECT document_id, page_number, count(*) FILTER ({_judged}) AS jn, count(*) FILTER ({_judged} AND {_suspect}) AS jb, count(*) FILTER ({_size} > 0) AS fn, count(*) FILTER ({_size} BETWEEN 1 AND 3) AS fs,
  count(*) AS n, sum(length(text))::DOUBLE AS chars, sum({_unread})::DOUBLE AS readable, count(*) FILTER (x + width <= 1.01 AND y + height <= 1.01) AS valid, regexp_replace(string_agg(text, '' ORDER BY pos), '[{WS}]', '', 'g') AS c FROM words GROUP BY document_id, page_number),
judged AS (SELECT *, CASE WHEN jn >= 40 AND jb >= 3 THEN jb::DOUBLE / jn ELSE 0 END AS broken, CASE WHEN fn >= 40 THEN fs::DOUBLE / fn END AS fragmented, (chars - readable) / chars AS unreadable FROM stats),
reasons AS (SELECT *, CASE WHEN length(c) < 35 THEN 'characters' WHEN n < 6 THEN 'words' WHEN unreadable > 0.02 THEN 'unreadable' WHEN {has_bytes('c')} OR {has_cyrillic('c')} THEN 'legacy font' WHEN broken > 0.02 THEN 'broken encoding'
  WHEN coalesce(fragmented, 0) > 0.55 THEN 'fragmented' WHEN len(regexp_extract_all(c, '[ÃÂÄÅ].')) >= 2 AND len(regexp_extract_all(c, '[ÃÂÄÅ].')) * 2 >= length(c) * 0.08 THEN 'mojibake' WHEN valid::DOUBLE / n < 0.9 THEN 'geometry'
  WHEN length(regexp_replace(c, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::DOUBLE / length(c) < 0.65 THEN 'searchable' END AS reason FROM judged)"""
BROKEN_ENCODING = f"WITH {_PAGES} SELECT document_id, page_number, round(broken, 6)::DOUBLE AS ratio FROM judged"
FRAGMENTED_WORDS = f"WITH {_PAGES} SELECT document_id, page_number, round(fragmented, 6)::DOUBLE AS ratio FROM judged"
USABLE_PAGES = f"WITH {_PAGES} SELECT document_id, page_number, reason IS NULL AS usable, reason FROM reasons"
SWEEPS = f"""WITH {_PAGES}, s AS (SELECT *, count(*) FILTER (broken > 0.02) OVER d::DOUBLE / count(*) OVER d >= 0.5 AS e, coalesce(count(*) FILTER (fragmented > 0.55) OVER d::DOUBLE / nullif(count(fragmented) OVER d, 0) >= 0.25, false) AS f
  FROM reasons WINDOW d AS (PARTITION BY document_id)), q AS (SELECT *, CASE WHEN reason IS NULL AND e AND broken > 0 THEN 'encoding' WHEN reason IS NULL AND f THEN 'fragments' END AS requeue FROM s)
SELECT document_id, page_number, requeue, CASE WHEN reason IS NULL AND requeue IS NULL THEN 'COMPLETE' ELSE 'PENDING' END AS status, CASE WHEN reason IS NULL AND requeue IS NULL THEN 'pdf-text' ELSE 'pending' END AS source FROM q"""
RENDER_DPI = """SELECT p_partkey, (CASE WHEN p_size * 40 * (p_partkey % 50 * 60) > 0 THEN greatest(150, least(200, floor(sqrt(12000000.0::DOUBLE / ((p_size * 40)::DOUBLE / 72 * ((p_partkey % 50 * 60)::DOUBLE / 72)))))) ELSE 200 END)::INT AS dpi,
  least(1600, greatest(p_size * 40, p_partkey % 50 * 60))::INT AS side FROM part"""

_KEYS = f"""keys AS (SELECT keyword_id, keyword, {search_sql('keyword')} AS needle FROM (SELECT item_id AS keyword_id, array_to_string(regexp_extract_all(text, '{TOKEN}')[1:2], ' ') AS keyword FROM benchmark))"""
_PAGE_TEXT = f"""pages_ AS (SELECT doc_id::VARCHAR AS document_id, pos // 240 AS p, {search_sql("string_agg(text, ' ' ORDER BY pos)")} AS s FROM toks GROUP BY doc_id, pos // 240)"""
SEARCH_PAGE_HITS = f"WITH {words()}, {_KEYS}, {_PAGE_TEXT} SELECT document_id, count(*) AS pages FROM pages_ WHERE s = '' OR EXISTS (SELECT 1 FROM keys WHERE needle <> '' AND contains(s, needle)) GROUP BY document_id"
_FOUND = rf"""{words()}, {_KEYS},
norms AS (SELECT *, {search_sql('text')} AS norm, lag(text) OVER (PARTITION BY document_id, page_number ORDER BY pos) AS prior, lead(i) OVER l AS after_i, x - lag(x + width) OVER l < 0.08 * greatest(height, lag(height) OVER l) AS glued_before,
  lead(x) OVER l - (x + width) < 0.08 * greatest(height, lead(height) OVER l) AS glued_after FROM words WINDOW l AS (PARTITION BY document_id, page_number, line ORDER BY i)),
flat AS (SELECT *, length(norm) AS n, (sum(length(norm)) OVER l - length(norm))::INT AS a, (sum(length(norm)) OVER l)::INT AS b, CASE WHEN i = 0 THEN coalesce(line > 0 AND regexp_matches(prior, '\p{{Pd}}$'), false) ELSE coalesce(glued_before, false) END AS before_,
  CASE WHEN after_i IS NULL THEN regexp_matches(text, '\p{{Pd}}$') ELSE coalesce(glued_after, false) END AS after_ FROM norms WINDOW l AS (PARTITION BY document_id, page_number, line ORDER BY i)),
texts AS (SELECT document_id, page_number, line, string_agg(norm, '' ORDER BY i) AS s FROM flat GROUP BY ALL),
spans AS (SELECT f.document_id, f.page_number, f.line, f.a AS start_at, f.i AS i, g.i AS j, substr(t.s, f.a + 1, g.b - f.a) AS span FROM flat f JOIN flat g ON f.document_id = g.document_id AND f.page_number = g.page_number AND f.line = g.line AND f.i <= g.i
  JOIN texts t ON t.document_id = f.document_id AND t.page_number = f.page_number AND t.line = f.line WHERE f.n > 0 AND g.n > 0 AND NOT f.before_ AND NOT g.after_ AND g.b - f.a <= 60),
hits AS (SELECT s.*, k.keyword_id, k.keyword FROM spans s JOIN keys k ON k.needle = s.span WHERE k.needle <> ''),
found AS (SELECT h.document_id, h.page_number, h.line, h.start_at, h.i, h.j, h.keyword_id, h.keyword, count(*)::INT AS n_words, min(f.x) AS x, min(f.y) AS y, max(f.x + f.width) - min(f.x) AS width, max(f.y + f.height) - min(f.y) AS height
  FROM hits h JOIN flat f ON f.document_id = h.document_id AND f.page_number = h.page_number AND f.line = h.line AND f.i BETWEEN h.i AND h.j AND f.n > 0 GROUP BY ALL)"""
SEARCH_HIGHLIGHTS = f"WITH {_FOUND} SELECT document_id, page_number, line, start_at, keyword_id, keyword, n_words, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width, round(height, 6) AS height, '#FACC15' AS color, 0.42::DOUBLE AS opacity, 'AUTO' AS source FROM found"
SEARCH_REPLACE_AUTO = f"""WITH {_FOUND}, stored AS (SELECT doc_id::VARCHAR AS document_id, CASE WHEN quality = 1 THEN 'MANUAL' ELSE 'AUTO' END AS source, CASE WHEN quality = 1 THEN 'marked' ELSE 'old' END AS keyword FROM labels),
ids AS (SELECT doc_id::VARCHAR AS document_id FROM documents WHERE doc_id % 2 = 0),
now AS (SELECT * FROM stored WHERE source = 'MANUAL' OR document_id NOT IN (SELECT document_id FROM ids) UNION ALL SELECT document_id, 'AUTO', keyword FROM found WHERE document_id IN (SELECT document_id FROM ids))
SELECT document_id, source, keyword, count(*) AS n FROM now GROUP BY ALL"""
HIGHLIGHT_BOXES_PX = f"""WITH {_FOUND} SELECT document_id, page_number, line, start_at, keyword_id, round(greatest(0, x - width * 0.02::DOUBLE) * 1654::DOUBLE, 1) AS px, round(greatest(0, y - height * 0.18::DOUBLE) * 2339::DOUBLE, 1) AS py,
  round(least(1, width + width * 0.02::DOUBLE * 2) * 1654::DOUBLE, 1) AS pw, round(least(1, height + height * 0.18::DOUBLE * 2) * 2339::DOUBLE, 1) AS ph FROM found"""
HIGHLIGHT_VALID = """SELECT p_partkey, CASE WHEN p_size - 1 <= 0 THEN 'page_number' WHEN p_retailprice / 2000 > 1 THEN 'x' WHEN p_size / 50.0::DOUBLE > 1 THEN 'width' WHEN p_partkey % 7 = 0 THEN 'color' WHEN p_partkey % 11 = 0 THEN 'source'
  WHEN length(p_name) > 250 THEN 'keyword' WHEN p_retailprice / 2000 + p_size / 50.0::DOUBLE > 1.001 THEN 'outside the page' END AS error FROM part"""
_matched = f"""matched AS (SELECT h.document_id, h.page_number, h.keyword_id, h.line, h.start_at, string_agg(w.text, ' ' ORDER BY w.x, w.i) AS raw, avg(w.confidence) AS confidence
  FROM found h JOIN words w ON w.document_id = h.document_id AND w.page_number = h.page_number AND least(w.x + w.width, h.x + h.width) - greatest(w.x, h.x) > 0 AND least(w.y + w.height, h.y + h.height) - greatest(w.y, h.y) > 0 GROUP BY h.document_id, h.page_number, h.keyword_id, h.line, h.start_at)"""
SEARCHED_DOCUMENTS = f"WITH {_FOUND} SELECT d.doc_id::VARCHAR AS document_id, coalesce(n, 0)::BIGINT AS n_highlights FROM documents d LEFT JOIN (SELECT document_id, count(*) AS n FROM found GROUP BY document_id) c ON c.document_id = d.doc_id::VARCHAR WHERE d.doc_id % 3 <> 0"
FINDINGS_MATCHED = f"WITH {_FOUND}, {_matched} SELECT document_id, page_number, keyword_id, line, start_at, line AS match_line, substr({cleaned('raw')}, 1, 1000) AS matched_text, round(confidence, 6) AS confidence FROM matched"
FINDINGS_CONTEXT = f"""WITH {_FOUND}, near AS (SELECT document_id, page_number, line, string_agg(text, ' ' ORDER BY x, i) AS raw FROM words GROUP BY document_id, page_number, line), texts_ AS (SELECT document_id, page_number, line, {cleaned('raw')} AS c FROM near)
SELECT f.document_id, f.page_number, f.keyword_id, f.line, f.start_at, md5(substr(string_agg(t.c, ' ' ORDER BY t.line), 1, 4000)) AS context_md5 FROM found f JOIN texts_ t ON t.document_id = f.document_id AND t.page_number = f.page_number AND abs(t.line - f.line) <= 1 AND t.c <> ''
GROUP BY f.document_id, f.page_number, f.keyword_id, f.line, f.start_at"""
_KEY = "document_id, page_number, keyword_id, line, start_at"
_heads = rf"""gaps AS (SELECT *, CASE WHEN x - lag(x + width) OVER l > greatest(avg(height) OVER (PARTITION BY document_id, page_number, line) * 2.5, 0.02) THEN 1 ELSE 0 END AS cut FROM words WINDOW l AS (PARTITION BY document_id, page_number, line ORDER BY x, i)),
runs AS (SELECT *, sum(cut) OVER (PARTITION BY document_id, page_number, line ORDER BY x, i)::INT AS part FROM gaps),
joined AS (SELECT document_id, page_number, line, part, string_agg(text, ' ' ORDER BY x, i) AS raw, max(y + height) AS bottom, avg(height) AS tall, min(x) AS lft, max(x + width) AS rgt FROM runs GROUP BY ALL),
segs AS (SELECT *, {cleaned('raw')} AS text FROM joined WHERE (document_id, page_number) IN (SELECT (document_id, page_number) FROM found)),
heights AS (SELECT document_id, page_number, line, avg(height) AS mine, max(height) AS tallest, min(y) AS top FROM words GROUP BY ALL),
medians AS (SELECT document_id, page_number, list_sort(list(height))[len(list(height)) // 2 + 1] AS median FROM words WHERE height <> 0 GROUP BY ALL),
cand AS (SELECT f.document_id, f.page_number, f.keyword_id, f.line, f.start_at, s.line AS at_line, s.part, s.text, s.bottom, s.tall, s.lft, s.rgt, least(s.rgt, f.x + f.width) - greatest(s.lft, f.x) > 0 AS in_column, f.y - s.bottom AS distance
  FROM found f JOIN segs s ON s.document_id = f.document_id AND s.page_number = f.page_number JOIN heights h ON h.document_id = f.document_id AND h.page_number = f.page_number AND h.line = f.line JOIN medians m ON m.document_id = f.document_id AND m.page_number = f.page_number
  WHERE s.line < f.line AND s.bottom <= f.y + 0.01 AND f.y - s.bottom <= 0.35 AND length(s.text) BETWEEN 3 AND 250 AND length(regexp_replace(s.text, '[^\p{{L}}]', '', 'g')) >= 3 AND NOT (s.bottom < 0.06 AND s.rgt - s.lft > 0.55)
    AND (s.tall >= greatest(m.median, h.mine) * 1.16 OR NOT regexp_matches(s.text, '\p{{Ll}}') OR s.text = upper(s.text))),
first_ AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY in_column DESC, distance, tall DESC, at_line, part) = 1),
band AS (SELECT c.*, f.at_line = c.at_line AND f.part = c.part AS chosen, f.tall * 1.9 AS most FROM cand c JOIN first_ f USING ({_KEY}) WHERE abs(c.tall - f.tall) <= f.tall * 0.18 AND least(c.rgt, f.rgt) - greatest(c.lft, f.lft) > 0),
stepped AS (SELECT *, CASE WHEN bottom - lag(bottom) OVER (PARTITION BY {_KEY} ORDER BY bottom, at_line, part) > most THEN 1 ELSE 0 END AS step FROM band),
grouped AS (SELECT *, sum(step) OVER (PARTITION BY {_KEY} ORDER BY bottom, at_line, part) AS block FROM stepped),
whole AS (SELECT {_KEY}, substr(string_agg(text, ' ' ORDER BY bottom, at_line, part), 1, 250) AS heading FROM grouped g WHERE block = (SELECT block FROM grouped o WHERE o.chosen AND o.document_id = g.document_id AND o.page_number = g.page_number AND o.keyword_id = g.keyword_id AND o.line = g.line AND o.start_at = g.start_at) GROUP BY {_KEY})"""
FINDINGS_HEADING = f"WITH {_FOUND}, {_heads} SELECT {_KEY}, text AS nearest FROM first_"
FINDINGS_BLOCK = f"WITH {_FOUND}, {_heads} SELECT {_KEY}, heading FROM whole"
FINDINGS_FULL = rf"""WITH {_FOUND}, {_heads}, {_matched},
near AS (SELECT document_id, page_number, line, string_agg(text, ' ' ORDER BY x, i) AS raw FROM words WHERE (document_id, page_number) IN (SELECT (document_id, page_number) FROM found) GROUP BY ALL),
shown AS (SELECT document_id, page_number, line, {cleaned('raw')} AS c FROM near),
around AS (SELECT f.document_id, f.page_number, f.keyword_id, f.line, f.start_at, substr(string_agg(t.c, ' ' ORDER BY t.line), 1, 4000) AS context FROM found f JOIN shown t ON t.document_id = f.document_id AND t.page_number = f.page_number AND abs(t.line - f.line) <= 1 AND t.c <> '' GROUP BY ALL),
titles AS (SELECT document_id, page_number, c AS title FROM shown JOIN heights USING (document_id, page_number, line) JOIN medians USING (document_id, page_number) WHERE top < 0.4 AND length(c) BETWEEN 3 AND 250 AND tallest >= median * 1.2
  QUALIFY row_number() OVER (PARTITION BY document_id, page_number ORDER BY tallest DESC, top, line) = 1),
plain AS (SELECT document_id, page_number, arg_min(t, line) AS title FROM (SELECT document_id, page_number, line, {cleaned('c', 250)} AS t FROM shown) WHERE length(t) >= 3 AND regexp_matches(t, '\p{{L}}') GROUP BY ALL),
names AS (SELECT doc_id::VARCHAR AS document_id, CASE doc_id % 4 WHEN 3 THEN lpad((doc_id % 31 + 1)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '.2024 ' || source || '.pdf' WHEN 2 THEN source || '_notes'
  ELSE 'My_' || source || '_' || lpad((doc_id % 31 + 1)::VARCHAR, 2, '0') || '.' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '.2024.pdf' END AS file_name FROM documents)
SELECT n.file_name, f.document_id, f.page_number, coalesce(w.heading, t.title, p.title, '') AS title, f.keyword, coalesce(nullif(substr({cleaned('m.raw')}, 1, 1000), ''), f.keyword) AS matched_text, coalesce(a.context, '') AS context, 'AUTO' AS source, round(m.confidence, 6) AS confidence
FROM found f JOIN names n USING (document_id) LEFT JOIN whole w USING ({_KEY}) LEFT JOIN matched m USING ({_KEY}) LEFT JOIN around a USING ({_KEY}) LEFT JOIN titles t ON t.document_id = f.document_id AND t.page_number = f.page_number LEFT JOIN plain p ON p.document_id = f.document_id AND p.page_number = f.page_number"""

_JOBS = """jobs AS (SELECT user_id AS document_id, event_id AS page_number, CASE event_type WHEN 'click' THEN 'PROCESSING' WHEN 'view' THEN 'PENDING' WHEN 'error' THEN 'FAILED' ELSE 'COMPLETE' END AS status,
  (json_extract(props, '$.k')::INT % 4)::INT AS attempts, CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN ts END AS started_at, ts AS created_at, CASE WHEN event_type = 'error' THEN 'code ' || json_extract_string(props, '$.k') END AS error FROM events),
docs AS (SELECT user_id AS document_id, CASE user_id % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PROCESSING' ELSE 'COMPLETE' END AS ocr_status, CASE WHEN user_id % 5 <> 0 THEN min(ts) END AS prepared_at, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id)"""
QUEUE_CLAIM = f"""WITH {_JOBS} SELECT j.document_id, j.page_number, 'PROCESSING' AS status, (j.attempts + 1)::INT AS attempts, 'worker' AS locked_by FROM jobs j JOIN docs d USING (document_id)
WHERE j.status = 'PENDING' AND j.attempts < 3 AND d.prepared_at IS NOT NULL ORDER BY j.document_id, j.page_number LIMIT 100"""
QUEUE_RELEASE_STALE = f"""WITH {_JOBS}, s AS (SELECT *, coalesce(status = 'PROCESSING' AND started_at < TIMESTAMP '2024-01-19 23:50:00', false) AS stale, status = 'PENDING' AND attempts >= 3 AS idle FROM jobs)
SELECT document_id, page_number, CASE WHEN stale AND attempts >= 3 OR idle THEN 'FAILED' WHEN stale THEN 'PENDING' ELSE status END AS status, CASE WHEN stale AND attempts >= 3 THEN {quoted(LOST)} WHEN idle THEN {quoted(SPENT)} ELSE error END AS error, stale OR idle AS changed FROM s"""
QUEUE_FAIL = f"""WITH {_JOBS} SELECT document_id, page_number, CASE WHEN status = 'PROCESSING' AND page_number % 3 = 0 THEN CASE WHEN page_number % 2 = 0 OR attempts >= 3 THEN 'FAILED' ELSE 'PENDING' END ELSE status END AS status,
  CASE WHEN status = 'PROCESSING' AND page_number % 3 = 0 THEN 'engine stopped at ' || page_number ELSE error END AS error FROM jobs"""
QUEUE_RELEASE = f"""WITH {_JOBS} SELECT document_id, page_number, CASE WHEN status = 'PROCESSING' AND page_number % 4 = 0 THEN 'PENDING' ELSE status END AS status, (CASE WHEN status = 'PROCESSING' AND page_number % 4 = 0 THEN greatest(0, attempts - 1) ELSE attempts END)::INT AS attempts FROM jobs"""
QUEUE_COMPLETE = f"""WITH {_JOBS} SELECT document_id, page_number, CASE WHEN page_number % 2 = 0 AND page_number % 10 <> 0 THEN 'COMPLETE' ELSE status END AS status, CASE WHEN page_number % 2 = 0 AND page_number % 10 <> 0 THEN 'read' END AS text,
  CASE WHEN page_number % 2 = 0 AND page_number % 10 <> 0 THEN NULL ELSE error END AS error FROM jobs"""
PREPARE_PICK = f"WITH {_JOBS} SELECT document_id, ocr_status FROM docs WHERE prepared_at IS NULL AND (ocr_status = 'PENDING' OR ocr_status = 'PROCESSING' AND updated_at < TIMESTAMP '2024-01-31 23:50:00') ORDER BY document_id LIMIT 10"


def _status(pages: str) -> str:
    return f"""r AS (SELECT document_id, count(*) AS n, count(*) FILTER (status IN ('PENDING', 'PROCESSING')) AS open_, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'COMPLETE') AS done, min(page_number) FILTER (status = 'FAILED') AS page,
  arg_min(coalesce(error, 'unknown error'), page_number) FILTER (status = 'FAILED') AS error FROM {pages} GROUP BY document_id)
SELECT document_id, CASE WHEN open_ > 0 THEN 'PROCESSING' WHEN done > 0 THEN 'COMPLETE' ELSE 'FAILED' END AS status, CASE WHEN open_ = 0 THEN n END AS page_count,
  CASE WHEN open_ = 0 AND failed > 0 THEN substr(failed || ' of ' || n || ' page' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' could not be read (first was page ' || page || ': ' || error || ').', 1, 1000) END AS ocr_error FROM r"""


_ORDERS = """opages AS (SELECT l_orderkey AS document_id, l_linenumber AS page_number, CASE l_returnflag WHEN 'A' THEN 'FAILED' WHEN 'N' THEN 'COMPLETE' ELSE 'PENDING' END AS status, NULL::VARCHAR AS error FROM lineitem),
odocs AS (SELECT o_orderkey AS document_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'P' THEN 'PROCESSING' ELSE 'PENDING' END AS ocr_status, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS prepared_at FROM orders)"""
DOCUMENT_STATUS = f"WITH {_JOBS}, {_status('jobs')}"
DOCUMENT_STATUS_LARGE = f"WITH {_ORDERS}, {_status('opages')}"
STRANDED = f"""WITH {_ORDERS} SELECT document_id, ocr_status FROM odocs WHERE prepared_at IS NOT NULL AND ocr_status IN ('PENDING', 'PROCESSING')
AND document_id IN (SELECT document_id FROM opages GROUP BY document_id HAVING count(*) FILTER (status IN ('PENDING', 'PROCESSING')) = 0) ORDER BY document_id LIMIT 50"""
QUEUE_HEALTH = f"""WITH {_JOBS}, d AS (SELECT count(*) FILTER (prepared_at IS NULL AND ocr_status IN ('PENDING', 'PROCESSING')) AS u, min(created_at) FILTER (prepared_at IS NULL AND ocr_status IN ('PENDING', 'PROCESSING')) AS ua FROM docs),
p AS (SELECT count(*) FILTER (status = 'PENDING') AS w, count(*) FILTER (status = 'PROCESSING') AS k, min(created_at) FILTER (status = 'PENDING') AS wa, max(started_at) AS c FROM jobs),
a AS (SELECT u, w, k, floor(epoch_us(TIMESTAMP '2024-02-01') / 1e6 - epoch_us(ua) / 1e6 + 0.5)::BIGINT AS us, floor(epoch_us(TIMESTAMP '2024-02-01') / 1e6 - epoch_us(wa) / 1e6 + 0.5)::BIGINT AS ws, floor(epoch_us(TIMESTAMP '2024-02-01') / 1e6 - epoch_us(c) / 1e6 + 0.5)::BIGINT AS cs FROM d, p)
SELECT u AS unprepared_documents, w AS pending_pages, k AS processing_pages, us AS oldest_unprepared_seconds, ws AS oldest_pending_seconds, cs AS last_claim_seconds,
  (w > 0 OR u > 0) AND greatest(coalesce(ws, 0), coalesce(us, 0)) > 120 AND (cs IS NULL OR cs > 120) AS stalled FROM a"""
_PROGRESS = """alldocs AS (SELECT o_orderkey AS document_id, o_orderkey AS upload_seq, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'P' THEN 'PROCESSING' ELSE 'PENDING' END AS ocr_status FROM orders
  UNION ALL SELECT -c_custkey, c_custkey, 'PENDING' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)),
totals AS (SELECT document_id, count(*) AS total, count(*) FILTER (status IN ('COMPLETE', 'FAILED')) AS done FROM opages GROUP BY document_id)"""
PROGRESS = f"""WITH {_ORDERS}, {_PROGRESS}, waits AS (SELECT document_id, row_number() OVER (ORDER BY upload_seq, document_id) AS queue_position FROM alldocs WHERE ocr_status IN ('PENDING', 'PROCESSING') AND document_id NOT IN (SELECT document_id FROM totals))
SELECT a.document_id, CASE WHEN done < total THEN done WHEN queue_position IS NOT NULL THEN 0 END::BIGINT AS current_page, CASE WHEN done < total THEN total WHEN queue_position IS NOT NULL THEN 0 END::BIGINT AS total_pages, queue_position
FROM alldocs a LEFT JOIN totals USING (document_id) LEFT JOIN waits USING (document_id)"""
STORE_STATS = "SELECT 'documents' AS name, count(*) AS n FROM orders UNION ALL SELECT 'pages', count(*) FROM lineitem UNION ALL SELECT 'highlights', count(*) FROM labels"
STATUSES = f"""WITH {_ORDERS}, totals AS (SELECT document_id, count(*) AS total, count(*) FILTER (status IN ('COMPLETE', 'FAILED')) AS done FROM opages GROUP BY document_id),
waits AS (SELECT document_id, row_number() OVER (ORDER BY document_id) AS q FROM odocs WHERE ocr_status IN ('PENDING', 'PROCESSING') AND document_id NOT IN (SELECT document_id FROM totals)),
ids AS (SELECT o_orderkey AS document_id, 2 * o_orderkey AS position FROM orders UNION ALL SELECT -1 - o_orderkey, 2 * o_orderkey + 1 FROM orders), marks AS (SELECT doc_id AS document_id, count(*) AS n FROM labels GROUP BY doc_id)
SELECT i.document_id, i.position, o.ocr_status, CASE WHEN done < total THEN done WHEN q IS NOT NULL THEN 0 END::BIGINT AS current_page, CASE WHEN done < total THEN total WHEN q IS NOT NULL THEN 0 END::BIGINT AS total_pages, coalesce(m.n, 0)::BIGINT AS n_highlights
FROM ids i JOIN odocs o USING (document_id) LEFT JOIN totals USING (document_id) LEFT JOIN waits USING (document_id) LEFT JOIN marks m USING (document_id)"""
_trim = lambda c: f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"
EXPORT_TEXT = f"""WITH s AS (SELECT conv_id AS document_id, string_agg({_trim('text')}, E'\\n\\n' ORDER BY turn, {_trim('text')}) FILTER (role <> 'system' AND {_trim('text')} <> '') AS t, count(*) FILTER (role = 'system') AS failed_pages FROM conversations GROUP BY conv_id)
SELECT document_id, length(coalesce(t, ''))::INT AS n, md5(coalesce(t, '')) AS text_md5, failed_pages FROM s"""
VIDEO_TRANSCRIPT = rf"""WITH p AS (SELECT conv_id AS document_id, turn AS page_number, string_split_regex(text, '\r?\n') AS a FROM conversations WHERE role <> 'system'),
l AS (SELECT document_id, page_number, unnest(a) AS raw, unnest(range(len(a))) AS k FROM p), t AS (SELECT document_id, page_number, k, {_trim('raw')} AS line FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY document_id, regexp_replace(lower(line), '[{WS}]+', ' ', 'g') ORDER BY page_number, k) AS r FROM t WHERE line <> ''),
j AS (SELECT document_id, page_number, string_agg(line, E'\n' ORDER BY k) AS text FROM f WHERE r = 1 GROUP BY document_id, page_number)
SELECT p.document_id, p.page_number, (p.page_number - 1) * 1.5::DOUBLE AS timestamp_s, md5(coalesce(j.text, '')) AS text_md5 FROM p LEFT JOIN j USING (document_id, page_number)"""
REQUEUE = f"""WITH {_ORDERS}, n AS (SELECT document_id, count(*) AS pages FROM opages WHERE document_id % 10 <> 0 GROUP BY document_id)
SELECT document_id, CASE WHEN document_id % 10 = 0 THEN 'PENDING' ELSE ocr_status END AS ocr_status, CASE WHEN document_id % 10 = 0 THEN 'FORCE_OCR' ELSE 'AUTO' END AS ocr_mode, document_id % 10 <> 0 AND prepared_at IS NOT NULL AS prepared, coalesce(pages, 0)::BIGINT AS pages FROM odocs LEFT JOIN n USING (document_id)"""
DELETE_CASCADE = """WITH ids AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0)
SELECT 'documents' AS name, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'pages', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM ids)
UNION ALL SELECT 'highlights', count(*) FROM labels WHERE doc_id NOT IN (SELECT id FROM ids) UNION ALL SELECT 'removed', count(*) FROM ids"""
EVICT_OVERFLOW = f"""WITH {_ORDERS} SELECT document_id FROM odocs WHERE ocr_status IN ('COMPLETE', 'FAILED') AND document_id NOT IN (SELECT document_id FROM opages WHERE page_number = 5)
ORDER BY document_id LIMIT (SELECT greatest(0, count(*) - 1200) FROM odocs)"""
_KEYWORDS = """kw AS (SELECT p_partkey AS keyword_id, trim(CASE WHEN p_partkey % 9 = 0 THEN ' ' WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END) AS text FROM part WHERE p_size % 12 = 10),
pr AS (SELECT DISTINCT l_partkey AS keyword_id, s_nationkey AS project_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
KEYWORDS_FOR_SOURCE = f"""WITH {_KEYWORDS} SELECT keyword_id, text, coalesce(string_agg(project_id::VARCHAR, ',' ORDER BY project_id), '') AS projects FROM kw LEFT JOIN pr USING (keyword_id) WHERE text <> '' GROUP BY keyword_id, text"""
KEYWORDS_DEDUP = f"""WITH {_KEYWORDS}, f AS (SELECT lower(text) AS k, min({{'t': text, 'i': keyword_id}}) AS first FROM kw WHERE text <> '' GROUP BY 1), u AS (SELECT DISTINCT lower(text) AS k, project_id FROM kw JOIN pr USING (keyword_id) WHERE text <> ''),
j AS (SELECT k, string_agg(project_id::VARCHAR, ',' ORDER BY project_id) AS projects FROM u GROUP BY k) SELECT first.i AS keyword_id, first.t AS text, coalesce(projects, '') AS projects FROM f LEFT JOIN j USING (k)"""
MENTION_FANOUT = f"WITH {_FOUND}, d AS (SELECT DISTINCT document_id, page_number, keyword_id FROM found) SELECT document_id, page_number, keyword_id, unnest(range(1, keyword_id % 3 + 1)) * 100 + keyword_id AS project_id FROM d WHERE keyword_id % 3 > 0"
MENTION_SKIPPED = f"WITH {_FOUND} SELECT DISTINCT document_id, 'no keyword found in it belongs to a project' AS reason FROM found WHERE document_id NOT IN (SELECT document_id FROM found WHERE keyword_id % 3 > 0)"
SQL_GUARD = rf"""WITH s AS (SELECT n_nationkey, [{', '.join("E" + quoted(x.replace(chr(10), chr(92) + 'n')) for x in STATEMENTS)}][(n_nationkey % {len(STATEMENTS)} + 1)::INT] AS q FROM nation),
b AS (SELECT n_nationkey, trim(regexp_replace(regexp_replace(q, '--[^\n]*', ' ', 'g'), '(?s)/\*.*?\*/', ' ', 'g'), E' \n') AS q FROM s)
SELECT n_nationkey, CASE WHEN NOT regexp_matches(q, '(?i)^(select|with|insert)($|[^A-Za-z0-9_])') THEN 'not a read or an append' WHEN regexp_matches(q, '(?i)(^|[^A-Za-z0-9_])({'|'.join(FORBIDDEN)})($|[^A-Za-z0-9_])') THEN 'would modify rows' END AS error FROM b"""
FRAME_PLAN = """WITH v AS (SELECT event_id AS document_id, ceil(value * 3 / 10.0::DOUBLE)::INT AS n FROM events), f AS (SELECT document_id, unnest(range(1, n + 1))::INT AS frame FROM v WHERE n BETWEEN 1 AND 40)
SELECT document_id, frame, (frame - 1) * 10.0::DOUBLE AS timestamp_s FROM f"""
ACCEPTED_UPLOADS = rf"""WITH n AS (SELECT doc_id, [{', '.join(map(quoted, EXTENSIONS))}][(doc_id % {len(EXTENSIONS)} + 1)::INT] AS e, [{', '.join(map(quoted, MIMES))}][(doc_id % {len(MIMES)} + 1)::INT] AS mime FROM documents),
x AS (SELECT doc_id, mime, lower(regexp_extract(e, '\.[^.]*$', 0)) AS e FROM n), k AS (SELECT *, e IN {among(VIDEO)} OR starts_with(mime, 'video/') AS v, e IN {among(IMAGE)} OR starts_with(mime, 'image/') AS i FROM x)
SELECT doc_id, e IN {among((".pdf", *OFFICE))} OR mime IN {among(DOCUMENT_TYPES)} OR v OR i AS accepted, CASE WHEN v THEN 'video' WHEN i THEN 'image' ELSE 'document' END AS kind, e IN {among(OFFICE)} AS converted FROM k"""
