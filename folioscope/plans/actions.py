"""Queries of the store's actions, requests, settings and repairs, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import encoding, glyphs, repair, text
from folioscope.operators import keywords, layout, queue, search, status
from folioscope.plans import sql
from folioscope.plans.catalog import query
from folioscope.schema import mode_valid
from folioscope.sources import adapt
from folioscope.sources.adapt import table

MODES = ("auto", "Force_OCR", "FORCE", "", "AUTO ")
ORIGINS = ("https://a.example.com", "http://localhost:3000", "https://example.com", "https://b.a.example.com.evil.org", "null", "https://x.example.org")
ALLOWED = ("http://localhost:3000", "https://*.example.com")
SETTINGS = ("5", " 2.7 ", "0", "-4", "abc", "", "1e3", "Infinity", "0.4", "99999")


@query(f"""WITH {sql._ORDERS}, p AS (SELECT document_id, string_agg(page_number || ':' || status, ',' ORDER BY page_number, status) AS pages FROM opages GROUP BY document_id),
h AS (SELECT doc_id AS document_id, count(*) AS n FROM labels GROUP BY doc_id)
SELECT o_orderkey AS document_id, coalesce(pages, '') AS pages, coalesce(n, 0)::INT AS n_highlights FROM orders LEFT JOIN p ON o_orderkey = p.document_id LEFT JOIN h ON o_orderkey = h.document_id""")
def document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as nested pages, and labels as nested highlights."""
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").alias("page_number"), "toxic")
    d = status.document_detail(documents, adapt.order_pages(spark, sf_dir), marks)
    pages = F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["page_number"].cast("string"), p["status"])), ",")
    return d.select("document_id", F.coalesce(pages, F.lit("")).alias("pages"), F.coalesce(F.size("highlights"), F.lit(0)).alias("n_highlights"))


@query(f"WITH {sql._JOBS} SELECT count(*) FILTER (status IN ('PENDING', 'PROCESSING')) AS pending FROM jobs")
def pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.pending_pages(adapt.page_jobs(spark, sf_dir))


@query("SELECT event_id, greatest(0, floor((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 1000))::BIGINT AS duration_ms FROM events")
def processing_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", status.duration_ms(F.col("ts"), F.lit("2024-01-20")).alias("duration_ms"))


@query("""SELECT doc_id AS document_id, quality::INT AS page_number, 'old' AS note FROM labels WHERE doc_id % 10 <> 0
UNION ALL SELECT doc_id, 1, 'new' FROM documents WHERE doc_id % 10 = 0""")
def replace_all_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All highlights of every tenth document are replaced; what comes for others is not taken."""
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").cast("int").alias("page_number"), F.lit("old").alias("note"))
    d = table(spark, sf_dir, "documents")
    incoming = d.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.lit("new").alias("note"))
    return search.replace_all(stored, incoming, d.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("document_id")))


@query("SELECT doc_id AS document_id, CASE WHEN quality = 1 THEN 'MANUAL' ELSE 'AUTO' END AS source FROM labels WHERE quality = 1 OR doc_id % 3 <> 0")
def delete_auto_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "MANUAL").otherwise("AUTO").alias("source"))
    return search.delete_auto(stored, table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id")))


@query(f"""WITH {sql._ORDERS} SELECT document_id, page_number::BIGINT AS page_number, status, 2 AS attempts FROM opages WHERE document_id % 7 <> 0
UNION ALL SELECT document_id, page_number + 100, 'PENDING', 0 FROM opages WHERE document_id % 7 = 0""")
def replace_document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of every seventh order are replaced by new ones, without attempts."""
    pages = adapt.order_pages(spark, sf_dir).select("document_id", F.col("page_number").cast("long").alias("page_number"), "status", F.lit(2).alias("attempts"))
    new = pages.select("document_id", (F.col("page_number") + 100).alias("page_number"), F.lit("PENDING").alias("status"))
    ids = table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("document_id"))
    return queue.replace_pages(pages, new, ids)


@query("SELECT max(o_orderkey) AS max_result_id, count(*) AS n FROM orders")
def result_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.result_bounds(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("result_id")))


@query("""SELECT (ordinal_position - 1)::INT AS ordinal, column_name, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END AS data_type, true AS is_nullable
FROM information_schema.columns WHERE table_name = 'nation'""")
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.columns_of(table(spark, sf_dir, "nation"))


@query(f"SELECT doc_id, upper([{', '.join(map(sql.quoted, MODES))}][(doc_id % {len(MODES)} + 1)::INT]) IN ('AUTO', 'FORCE_OCR') AS valid FROM documents")
def reading_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", mode_valid(F.get(F.array(*map(F.lit, MODES)), (F.col("doc_id") % len(MODES)).cast("int"))).alias("valid"))


@query(f"SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^{sql.WS}]+')), -1)::INT AS n FROM documents WHERE text IS NOT NULL")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", text.word_count(F.col("text")).alias("n"))


@query(rf"""WITH o AS (SELECT doc_id, [{', '.join(map(sql.quoted, ORIGINS))}][(doc_id % {len(ORIGINS)} + 1)::INT] AS origin FROM documents)
SELECT doc_id, origin IN {sql.among(ALLOWED)} OR regexp_full_match(origin, 'https://.*\.example\.com') AS allowed FROM o""")
def allowed_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.get(F.array(*map(F.lit, ORIGINS)), (F.col("doc_id") % len(ORIGINS)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.origin_allowed(origin, list(ALLOWED)).alias("allowed"))


@query(f"""WITH s AS (SELECT doc_id, try_cast(trim([{', '.join(map(sql.quoted, SETTINGS))}][(doc_id % {len(SETTINGS)} + 1)::INT]) AS DOUBLE) AS x FROM documents)
SELECT doc_id, CASE WHEN x >= 0 AND x < 'Infinity'::DOUBLE THEN x ELSE 3.0 END::DOUBLE AS any_number, CASE WHEN x > 0 AND x < 'Infinity'::DOUBLE THEN least(x, 50.0) ELSE 7.0 END::DOUBLE AS positive,
  CASE WHEN x >= 1 AND x < 'Infinity'::DOUBLE THEN floor(x) ELSE 4.0 END::DOUBLE AS whole FROM s""")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read from settings, with fallbacks."""
    s = F.get(F.array(*map(F.lit, SETTINGS)), (F.col("doc_id") % len(SETTINGS)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.number_setting(s, 3).alias("any_number"), text.positive_setting(s, 7, most=50).alias("positive"), text.positive_setting(s, 4, whole=True).alias("whole"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 * 0.01 + l_linenumber % 2 * 0.0002 AS y, l_partkey % 100 / 100.0 AS x FROM lineitem)
SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY round(y, 3), x, l_linenumber) AS numbers FROM b GROUP BY l_orderkey""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as boxes that stand a little askew."""
    n = F.col("l_linenumber")
    box = F.struct(n.alias("n"), (n % 3 * 0.01 + n % 2 * 0.0002).alias("y"), (F.col("l_partkey") % 100 / 100.0).alias("x"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return orders.select("l_orderkey", F.array_join(F.transform(layout.reading_order(F.col("boxes")), lambda b: b["n"].cast("string")), ",").alias("numbers"))


@query("""WITH r AS (SELECT l_orderkey AS document_id, (l_linenumber % 3)::INT AS box_id, l_returnflag || l_linenumber AS text, l_discount::DOUBLE * 10 AS score FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id, box_id ORDER BY score DESC, text DESC) AS rank FROM r)
SELECT document_id, box_id, text, round(score, 6)::DOUBLE AS score FROM k WHERE rank = 1 AND score >= 0.45""")
def best_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several readings of a box, if it is good enough."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), (F.col("l_linenumber") % 3).cast("int").alias("box_id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"), (F.col("l_discount").cast("double") * 10).alias("score"), F.array(F.lit(0.25), F.lit(0.5)).alias("char_offsets"), (F.col("l_linenumber") % 2 == 0).alias("rotated"))
    return layout.best_readings(r).select("document_id", "box_id", "text", F.round("score", 6).alias("score"))


_CONSONANT = r"'^[^\P{L}aeiouəıöüAEIOUƏIİÖÜ]$'"
#: From left to right: what is before a letter is taken as it has become, what follows as it was.
_BREVE = f"""list_reduce(list_transform(range(1, length(w) + 1), lambda i: CASE WHEN i = 1 THEN substr(w, 1, 1) ELSE substr(w, i, 2) END),
  lambda a, x: a || CASE WHEN x[1] IN ('ğ', 'Ğ') AND regexp_matches(x[2:2], {_CONSONANT}) AND regexp_matches(a[-1:], {_CONSONANT}) THEN translate(x[1], 'ğĞ', 'üÜ') ELSE x[1] END)"""


@query(f"""SELECT doc_id, md5(array_to_string(list_transform(string_split(replace(text, 'u', 'ğ'), ' '), lambda w: CASE WHEN contains(w, 'ğ') OR contains(w, 'Ğ') THEN {_BREVE} ELSE w END), ' ')) AS text_md5 FROM documents""")
def breve_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts whose u was read as a breve g, word by word: the rule looks at neighbouring letters only."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(F.transform(F.split(F.translate("text", "u", "ğ"), " "), repair.umlauts), " ").cast("binary")).alias("text_md5"))


_LONE = r"'(^|[^\p{L}])([^\P{Ll}aeiouəıöü])($|[^\p{L}])', '\1\2ə\3', 'g'"


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, 'a', ' '), {_LONE}), {_LONE})) AS text_md5 FROM documents")
def lone_consonant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts whose letters a were lost, so that consonants stand alone."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(repair.lone_consonants(F.replace(F.col("text"), F.lit("a"), F.lit(" "))).cast("binary")).alias("text_md5"))


@query("""WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'aze' WHEN 1 THEN 'AZ+eng' WHEN 2 THEN 'eng+rus' ELSE 'azure' END AS told FROM documents)
SELECT doc_id, regexp_matches(told, '(?i)(^|[^A-Za-z0-9_])aze?($|[^A-Za-z0-9_])') OR contains(told, 'aze') AS repairs FROM l""")
def repair_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.get(F.array(*map(F.lit, ("aze", "AZ+eng", "eng+rus", "azure"))), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", repair.needs_repair(told).alias("repairs"))


@query("""WITH d AS (SELECT l_orderkey, list_sort(list(l_quantity::DOUBLE)) AS q FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, q[floor((len(q) - 1) * 0.4::DOUBLE + 0.5)::INT + 1] AS quantity FROM d""")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale of a line: an element at a rounded place."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("double"))).alias("q"))
    return d.select("l_orderkey", repair.nearest_rank(F.col("q"), 0.4).alias("quantity"))


_LEGACY = ("abvqdejziklmnoprstuf", "àáâãäåæçèêëìíîïðñòóô")


@query(rf"""WITH raw AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{sql.TOKEN}') AS t FROM documents)),
damaged AS (SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 AND pos % 2 = 0 THEN translate(w, '{_LEGACY[0]}', '{_LEGACY[1]}') ELSE w END AS w FROM raw),
pages_ AS (SELECT doc_id, pos // 240 + 1 AS page_number, string_agg(w, ' ' ORDER BY pos) AS s, count(*) FILTER (WHERE {sql.decoded('w')} <> w)::INT AS alone FROM damaged GROUP BY doc_id, pos // 240)
SELECT doc_id::VARCHAR AS document_id, page_number::INT AS page_number, {sql.has_bytes('s')} OR {sql.has_cyrillic('s')} AS repaired, alone, md5({sql.decoded('s')}) AS words_md5 FROM pages_""")
def legacy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of whose words every second one, in a third of the documents, is in a legacy font: the page decides for its words. alone: words that would be decoded by themselves."""
    tokens = F.transform(F.regexp_extract_all("text", F.lit(adapt.WORD), F.lit(0)), lambda t, i: F.when((F.col("doc_id") % 3 == 0) & (i % 2 == 0), F.translate(t, *_LEGACY)).otherwise(t))
    pages = adapt.page_slices(table(spark, sf_dir, "documents"), tokens).withColumn("r", encoding.repaired_page(F.col("tokens")))
    alone = F.size(F.filter("tokens", lambda t: encoding.decoded(t) != t))
    return pages.select("document_id", "page_number", "r.repaired", alone.alias("alone"), F.md5(F.array_join("r.words", " ").cast("binary")).alias("words_md5"))


@query(rf"""WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c, unnest(range(length(p_name))) AS i FROM part), w AS (SELECT *, {sql.width('c')} AS w FROM c),
placed AS (SELECT *, sum(w) OVER (PARTITION BY p_partkey ORDER BY i) - w / 2 AS at_ FROM w),
kept AS (SELECT *, lead(c) OVER o AS d, lead(at_) OVER o - at_ AS gap, (w + lead(w) OVER o) / 2 AS expected FROM placed WHERE c NOT IN ('a', 'e') WINDOW o AS (PARTITION BY p_partkey ORDER BY i)),
pairs AS (SELECT *, coalesce(regexp_matches(c, '\p{{L}}') AND regexp_matches(d, '\p{{L}}'), false) AS ok, NOT contains('{repair.VOWELS}', c) AND NOT contains('{repair.VOWELS}', d) AS open_ FROM kept),
scales AS (SELECT p_partkey, count(*) FILTER (ok) AS n, bool_or(ok AND open_) AS some, list_sort(list(gap / expected) FILTER (ok))[floor((count(*) FILTER (ok) - 1) * 0.4 + 0.5)::INT + 1] AS scale FROM pairs GROUP BY p_partkey),
filled AS (SELECT p.*, CASE WHEN s.n >= 3 AND s.some AND s.scale > 0 AND ok AND open_ AND gap / scale - expected >= 0.30 THEN least(2, greatest(1, floor((gap / scale - expected) / CASE WHEN regexp_matches(c, '\p{{Lu}}') AND regexp_matches(d, '\p{{Lu}}') THEN 0.63 ELSE 0.61 END)))::INT ELSE 0 END AS times,
  CASE WHEN regexp_matches(c, '\p{{Lu}}') AND coalesce(regexp_matches(d, '\p{{Lu}}'), false) THEN 'Ə' ELSE 'ə' END AS schwa FROM pairs p JOIN scales s USING (p_partkey))
SELECT p_partkey, string_agg(c || repeat(schwa, times), '' ORDER BY i) AS text, sum(times)::INT AS inserted, round(sum(at_ + CASE times WHEN 1 THEN at_ + gap / 2 WHEN 2 THEN 2 * at_ + gap ELSE 0 END), 4) AS offsets FROM filled GROUP BY p_partkey""")
def schwa_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names whose letters a and e were lost, with the places of those that are left; offsets: their sum with the restored ones'."""
    p = table(spark, sf_dir, "part").select("p_partkey", glyphs.chars(F.col("p_name")).alias("c"), glyphs.width_prefix(F.col("p_name")).alias("ends"))
    placed = F.transform("c", lambda c, i: F.struct(c.alias("c"), (F.get("ends", i + 1) - glyphs.glyph_width(c) / 2).alias("at")))
    p = p.select("p_partkey", F.filter(placed, lambda x: ~x["c"].isin("a", "e")).alias("k"))
    r = p.select("p_partkey", repair.restored_schwa(F.array_join(F.transform("k", lambda x: x["c"]), ""), F.transform("k", lambda x: x["at"])).alias("r")).filter("r.text <> ''")
    return r.select("p_partkey", "r.text", "r.inserted", F.round(F.aggregate("r.char_offsets", F.lit(0.0), lambda a, x: a + x), 4).alias("offsets"))
