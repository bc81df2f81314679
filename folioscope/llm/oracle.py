"""DuckDB SQL for those corpus queries that SQL expresses over whole tables."""

from __future__ import annotations

OP1 = r"""
WITH sized AS (
  SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
named AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][((k - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap,
  1.5::DOUBLE * sum(source_size) OVER () AS everything FROM named),
levels AS (SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighed),
chosen AS (SELECT arg_min(lvl, cap / weight) FILTER (lvl * weight < cap) AS lvl FROM levels),
aims AS (SELECT l.source, l.source_size, coalesce(least(l.cap, c.lvl * l.weight), l.cap)::DOUBLE AS target FROM levels l, chosen c),
rated AS (SELECT s.doc_id, s.text, s.size, a.source_size, a.target,
  CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0 END AS rate
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT
  + (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate))::BIGINT))::BIGINT AS taken
FROM rated
"""

OP4 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM q
"""

OP10 = r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
rest AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
parts AS (SELECT page_id, k, coalesce(translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
best AS (SELECT p.k, arg_max(u.host || u.path, length(u.host || u.path)) AS rule, arg_max(u.verdict, length(u.host || u.path)) AS verdict
  FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path) GROUP BY p.k)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (k)
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id::BIGINT AS doc_id, {_TERMS} AS terms FROM documents),
sized AS (SELECT k, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sized),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
tf AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY k, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term, docs),
part AS (SELECT tf.k, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * s.n * c.docs) // c.total))) AS v FROM tf JOIN w USING (term) JOIN sized s ON s.k = tf.k, corpus c),
scored AS (SELECT q.item_id, p.k, sum(p.v)::BIGINT AS score FROM part p JOIN q USING (term) GROUP BY q.item_id, p.k),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored JOIN sized USING (k) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": OP1, "op4_warc_revisits": OP4, "op10_url_rules": OP10, "op11_lexical_search": OP11}
