"""DuckDB SQL for the dealt operators that SQL can express, over the tables as views."""
from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, line, pos,
         trim(translate(line, '{_UPPER}', '{_LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.line, l.pos, c.k IS NOT NULL AND l.doc_id <> c.keeper AS goes
  FROM lines l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (goes)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

DECONTAMINATION = rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS w
  FROM items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT n FROM windows
), starts AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM split, sizes, unnest(range(1, len(ws) - n + 2)) AS u(i)
), hits AS (SELECT s.doc_id, s.i, s.n, w.item_id FROM starts s JOIN windows w ON s.w = w.w AND s.n = w.n
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT s.doc_id, len(s.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
       coalesce(f.n_items, 0)::BIGINT AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 AS klass
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE klass WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         (source_size * 2)::DOUBLE AS cap FROM totals
), leveled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (
              ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (
              ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, klass, least(cap, (max(level) OVER ()) * weight) AS target FROM leveled
), streamed AS (
  SELECT s.doc_id, s.size, t.source_size, t.klass, t.target, floor(t.target)::BIGINT AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, (least(greatest(whole - begun, 0), size) + least(greatest(whole - begun - source_size, 0), size))::BIGINT AS taken,
         begun::DOUBLE / target AS u FROM streamed
), pieces AS (
  SELECT *,
         CASE WHEN klass = 1 THEN 0.0::DOUBLE WHEN klass = 0 THEN CASE WHEN u >= 0.625 THEN 0.625 ELSE 0.0 END
              ELSE CASE WHEN u >= 0.375 THEN 0.375 ELSE 0.0 END END::DOUBLE AS done,
         CASE WHEN klass = 1 THEN 0.0 WHEN klass = 0 THEN CASE WHEN u >= 0.625 THEN 0.5 ELSE 0.0 END
              ELSE CASE WHEN u >= 0.375 THEN 0.5 ELSE 0.0 END END::DOUBLE AS start,
         CASE WHEN klass = 1 THEN 1.0 WHEN klass = 0 THEN CASE WHEN u >= 0.625 THEN 1.0 ELSE 1.5 END
              ELSE CASE WHEN u >= 0.375 THEN 1.0 ELSE 0.5 END END::DOUBLE AS w,
         CASE klass WHEN 1 THEN 0.0 WHEN 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS slope
  FROM taken
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(start + CASE WHEN u - done = 0 THEN 0.0::DOUBLE
         ELSE (u - done) * 2.0::DOUBLE / (w + sqrt(w * w + slope * (u - done) * 2.0::DOUBLE)) END, 9) END AS position
FROM pieces
"""

URL_FILTER = r"""
WITH named AS (
  SELECT page_id, 19723 + (page_id * 37) % 365 AS day,
         regexp_replace(lower(regexp_extract(coalesce(url, ''),
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#@]+)', 1)), '\.$', '') AS h,
         CASE WHEN h <> '' AND length(h) <= 253 THEN h END AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)', 1) AS seg,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*(?:/[^/?#]*)?)', 1) AS path
  FROM pages
), subjects AS (
  SELECT DISTINCT 'host' AS kind, host AS value FROM named WHERE host IS NOT NULL
  UNION SELECT DISTINCT 'domain', regexp_replace(host, '^[^.]*\.', '') FROM named
    WHERE host IS NOT NULL AND len(string_split(host, '.')) > 2
  UNION SELECT DISTINCT 'prefix', host || seg FROM named WHERE host IS NOT NULL
), deeper AS (
  SELECT kind, value, ('0x' || substr(md5(kind || value), 1, 8))::BIGINT AS d
  FROM (SELECT DISTINCT 'prefix' AS kind, upper(host) || path || '/' AS value FROM named WHERE host IS NOT NULL AND path <> seg)
), digests AS (
  SELECT kind, value, ('0x' || substr(md5(kind || value), 1, 8))::BIGINT AS d FROM subjects
), entries AS (
  SELECT kind, value, 2 AS strength, 19723 + (d // 8) % 200 AS day FROM digests WHERE kind = 'host' AND d % 8 < 3
  UNION ALL SELECT kind, value, 0, 19723 + (d // 8) % 200 + 30 + d % 60 FROM digests WHERE kind = 'host' AND d % 8 < 3
  UNION ALL SELECT kind, value, 2, 19723 + (d // 8) % 200 + 120 FROM digests
    WHERE kind = 'host' AND d % 8 < 3 AND (d // 1024) % 2 = 0
  UNION ALL SELECT kind, value, 2, 19723 + (d // 8) % 200 FROM digests WHERE kind = 'domain' AND d % 4 = 0
  UNION ALL SELECT kind, value, 1, 19723 + (d // 8) % 200 FROM digests WHERE kind = 'prefix' AND d % 8 = 0
  UNION ALL SELECT kind, value, 2, 19723 + (d // 8) % 200 FROM deeper WHERE d % 8 = 1
), history AS (
  SELECT kind || ':' || lower(regexp_extract(value, '^[^/]*')) ||
         regexp_replace(regexp_replace(value, '^[^/]*', ''), '^(/.*[^/])/+$', '\1') AS k, day, max(strength) AS strength FROM entries GROUP BY ALL
), spans AS (
  SELECT k, strength, day AS since, lead(day) OVER (PARTITION BY k ORDER BY day) AS until FROM history
), keys AS (
  SELECT DISTINCT host, path, day, 1001 AS rank, 'prefix:' || host || seg AS k FROM named WHERE host IS NOT NULL
  UNION SELECT DISTINCT host, path, day, 1002, 'prefix:' || host || path FROM named WHERE host IS NOT NULL AND path <> seg
  UNION SELECT DISTINCT host, path, day, 1000, 'host:' || host FROM named WHERE host IS NOT NULL
  UNION SELECT DISTINCT host, path, day, len(ls) - i + 1, 'domain:' || array_to_string(ls[i:], '.')
    FROM (SELECT *, string_split(host, '.') AS ls FROM named WHERE host IS NOT NULL),
         unnest(range(1, greatest(len(ls) - 1, 1) + 1)) AS u(i)
), active AS (
  SELECT q.host, q.path, q.day, q.rank, q.k, s.strength, s.since,
         row_number() OVER (PARTITION BY q.host, q.path, q.day ORDER BY q.rank DESC) AS place
  FROM keys q JOIN spans s ON q.k = s.k AND s.since <= q.day AND (s.until IS NULL OR q.day < s.until)
  WHERE s.strength > 0
)
SELECT n.page_id, n.day, n.host, CASE a.strength WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS verdict,
       a.k AS matched, a.since
FROM named n LEFT JOIN active a ON n.host = a.host AND n.path = a.path AND n.day = a.day AND a.place = 1
"""

INFILL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS s, length(coalesce(text, ''))::BIGINT AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), h AS (
  SELECT *, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3,
         ('0x' || d[25:32])::BIGINT AS h4 FROM t
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, substr(s, 1, a) AS prefix, substr(s, a + 1, b - a) AS middle, substr(s, b + 1) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(s) AS restored_sha256
FROM p
"""

FILTER_AUDIT = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS s,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), copies AS (SELECT s, min(doc_id) AS first FROM t GROUP BY s
), marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT t.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {
         'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws),
         'C': 100 * length(regexp_replace(t.s, '[^A-Z]+', '', 'g')) > 10 * length(t.s),
         'D': regexp_matches(t.s, '[#$%&*|]'), 'E': coalesce(t.doc_id > copies.first, false)} AS fails
  FROM t JOIN copies ON t.s = copies.s LEFT JOIN marks ON t.doc_id = marks.doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM docs GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT part, o AS filter_order, step, o[step] AS f, n, good, toxic, fails[o[step]] AS fail,
         list_any_value(list_filter(string_split(o[1:step - 1], ''), lambda x: x <> '' AND fails[x])) IS NOT NULL AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) = 1 AS alone
  FROM cells, orders, unnest([1, 2, 3, 4, 5]) AS u(step)
), sums AS (
  SELECT part, filter_order, step::INTEGER AS step, f, sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND fail THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fail AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM sums
"""
