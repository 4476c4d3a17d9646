"""Oracle SQL of the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

_WHITE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+"
_SITE_LINES = f"""b AS (SELECT DISTINCT id, nullif(regexp_replace(regexp_extract(lower(trim(source_url)), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', ''), '') AS site FROM books),
  c AS (SELECT DISTINCT c.id, site, content_source AS t FROM chapters c JOIN b ON c.book_id = b.id WHERE site IS NOT NULL),
  l AS (SELECT id, site, unnest(string_split(t, chr(10))) AS x, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no FROM c),
  k AS (SELECT id, site, line_no, regexp_replace(regexp_replace(x, '^{_WHITE}|{_WHITE}$', '', 'g'), '[0-9]+', chr(1), 'g') AS key FROM l),
  s AS (SELECT site, count(DISTINCT id) AS docs FROM c GROUP BY site),
  n AS (SELECT site, key, count(DISTINCT id) AS n FROM k WHERE key <> '' GROUP BY site, key)"""

_WINDOWS = """w AS (SELECT doc_id, unnest(range(1, length(text) - 198)) AS pos, unnest(list_transform(range(1, length(text) - 198), lambda k: md5_number(text[k:k + 199]))) AS h FROM documents WHERE length(text) >= 200),
  r AS (SELECT h, min(doc_id) AS rep_id, count(DISTINCT doc_id) AS n_docs FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), x AS (SELECT w.*, rep_id, n_docs FROM w JOIN r USING (h))"""

SQL: dict[str, str] = {
    "p10_classes": f"WITH {_WINDOWS} SELECT DISTINCT doc_id, rep_id, n_docs FROM x",
    "p10_shared_chars": f"""WITH {_WINDOWS},
      y AS (SELECT DISTINCT doc_id, pos FROM x),
      z AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM y)
      SELECT doc_id, CAST(sum(least(200, coalesce(nxt - pos, 200))) AS INTEGER) AS shared_chars, CAST(count(*) FILTER (nxt IS NULL OR nxt - pos > 200) AS INTEGER) AS n_spans FROM z GROUP BY doc_id""",
    "p2_found": f"""WITH {_SITE_LINES}
      SELECT DISTINCT k.id AS chapter_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN n ON k.site = n.site AND k.key = n.key JOIN s ON k.site = s.site WHERE n.n >= 5 AND n.n * 10 >= s.docs""",
    "p8_placed": """WITH d AS (SELECT doc_id, max(CASE WHEN n_tokens > 0 THEN n_tokens ELSE octet_length(encode(coalesce(text, ''))) + 1 END) AS n FROM documents GROUP BY doc_id)
      SELECT bin_class, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_cut FROM d, (SELECT DISTINCT bin_class FROM bins) GROUP BY bin_class""",
    "p9_found": """WITH i AS (SELECT DISTINCT item_id, regexp_replace(lower(passage), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM bench_items),
      g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(t) - 48), lambda k: t[k:k + 49])) AS g FROM i WHERE length(t) >= 50),
      d AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM documents),
      w AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - 48), lambda k: t[k:k + 49])) AS g FROM d WHERE length(t) >= 50)
      SELECT DISTINCT doc_id, item_id FROM w JOIN g USING (g)""",
    "p10_found": """WITH w AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(text) - 198), lambda k: md5_number(text[k:k + 199]))) AS h FROM documents WHERE length(text) >= 200),
      r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), x AS (SELECT w.* FROM w JOIN r USING (h))
      SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p9_proximity": """WITH i AS (SELECT DISTINCT item_id, regexp_replace(lower(passage), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM bench_items),
      g AS (SELECT item_id, unnest(range(0, length(t) - 24, 25)) AS q, unnest(list_transform(range(0, length(t) - 24, 25), lambda k: t[k + 1:k + 25])) AS g FROM i WHERE length(t) >= 25),
      d AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM documents),
      w AS (SELECT doc_id, unnest(range(0, length(t) - 24)) AS p, unnest(list_transform(range(0, length(t) - 24), lambda k: t[k + 1:k + 25])) AS g FROM d WHERE length(t) >= 25),
      f AS (SELECT item_id, g, min(q) AS q FROM g GROUP BY item_id, g),
      m AS (SELECT DISTINCT doc_id, item_id, p, q FROM w JOIN f USING (g)),
      x AS (SELECT *, lag(p) OVER o AS p0, lag(q) OVER o AS q0 FROM m WINDOW o AS (PARTITION BY doc_id, item_id ORDER BY p)),
      y AS (SELECT * FROM x WHERE q > q0 AND p - p0 BETWEEN 25 AND 400)
      SELECT doc_id, item_id, CAST(count(DISTINCT q) AS INTEGER) AS n_terms FROM (SELECT doc_id, item_id, q FROM y UNION ALL SELECT doc_id, item_id, q0 FROM y) GROUP BY ALL""",
    "p9_leaked_items": """WITH i AS (SELECT DISTINCT item_id, regexp_replace(lower(passage), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM bench_items),
      g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(t) - 48), lambda k: t[k:k + 49])) AS g FROM i WHERE length(t) >= 50),
      d AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM documents),
      w AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - 48), lambda k: t[k:k + 49])) AS g FROM d WHERE length(t) >= 50)
      SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM w JOIN g USING (g) GROUP BY item_id""",
}
