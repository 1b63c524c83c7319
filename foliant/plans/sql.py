"""SQL of the catalog's queries in DuckDB's dialect."""

from foliant.plans import services

_LINES = """lines AS (SELECT doc_id, source, CAST(doc_id % 210 AS INTEGER) AS page_number, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents)"""
_BOXES = """boxes AS (SELECT doc_id, ord, line AS text, (ord * 37 % 11) * 10.0 AS t, (ord * 53 % 7) * 5.0 AS l,
  ((doc_id * 31 + ord * 17) % 128) / 128.0 AS score FROM lines)"""
_TOC = "toc AS (SELECT printf('lesson_%02d', i + 1) AS lesson_id, 7 + (i * 191) // 44 AS a, 7 + ((i + 1) * 191) // 44 - 1 AS b FROM range(44) r(i))"
_PAGES = """paged AS (SELECT doc_id, CAST(doc_id % 210 AS INTEGER) AS page_number, coalesce((SELECT min(lesson_id) FROM toc WHERE doc_id % 210 BETWEEN a AND b),
  'Ngoai_TOC') AS lesson_id FROM documents)"""
_TITLE = r"trim(regexp_replace(trim(line, ' #:-' || chr(9)), '\s+', ' ', 'g'))"
_HEAD = rf"""titled AS (SELECT *, {_TITLE} AS title, lower(translate(strip_accents({_TITLE}), 'Đđ', 'Dd')) AS low FROM lines),
sized AS (SELECT *, length(regexp_replace(title, '[^\p{{L}}]+', '', 'g')) AS n_l, length(regexp_replace(title, '[^\p{{Lu}}]+', '', 'g')) AS n_u FROM titled),
headed AS (SELECT *, length(title) BETWEEN 3 AND 140 AND NOT ends_with(title, '?') AND NOT regexp_matches(low, '^(hinh|bang|bieu do|so do)\s') AND (
 regexp_matches(low, '^(bai|chuong)\s*\d+\b') OR regexp_matches(low, '^(i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii)\.\s+') OR (regexp_matches(low, '^\d+[.)]\s+')
  AND length(title) <= 90)
 OR (n_l >= 5 AND n_u >= 0.65 * n_l AND len(string_split(title, ' ')) BETWEEN 2 AND 16)) AS heading FROM sized)"""
_VALUES = r"""raw AS (SELECT doc_id, unnest(string_split(text, ' ')) AS v, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
vals AS (SELECT doc_id, pos, regexp_replace(v, '[^a-zA-Z]', '', 'g') AS value FROM raw),
deduped AS (SELECT doc_id, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(value) ORDER BY pos) AS rn FROM vals WHERE value <> '')
  WHERE rn = 1)"""
_VECTOR = """vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
vs AS (SELECT query_id, vec_id AS chunk_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[],
  embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS score FROM embeddings, vq),
vtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs) WHERE rank <= 10)"""
_BM25 = r"""hq AS (SELECT item_id AS query_id, text, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON item_id = vec_id),
terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM hq),
toks AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ts FROM documents),
stat AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM toks),
flat AS (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM toks),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bs AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score FROM tf
  JOIN dfs USING (term) JOIN terms USING (term), stat GROUP BY query_id, chunk_id),
btop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs) WHERE rank <= 10)"""
_UPSERT = """base AS (SELECT doc_id, source, lang AS body, n_chars AS entities FROM documents WHERE doc_id % 2 = 0),
delta AS (SELECT doc_id, source, 'new' AS body FROM documents WHERE doc_id % 3 = 0 AND source IN ('src1', 'src2', 'src3')),
merged AS (SELECT coalesce(d.doc_id, b.doc_id) AS doc_id, coalesce(d.source, b.source) AS source, CASE WHEN d.doc_id IS NOT NULL THEN d.body
  ELSE b.body END AS body, b.entities,
 d.doc_id IS NOT NULL OR b.source NOT IN (SELECT source FROM delta) AS active, CASE WHEN d.doc_id IS NULL AND b.source IN (SELECT source
  FROM delta) THEN 'run-2' END AS replaced_by
 FROM base b FULL OUTER JOIN delta d ON b.doc_id = d.doc_id)"""
_EDGES = """edges AS (SELECT DISTINCT source AS src, 'CO_PHAN_DOAN' AS type, CAST(doc_id AS VARCHAR) AS dst FROM documents UNION ALL
  SELECT DISTINCT CAST(doc_id AS VARCHAR), 'DINH_NGHIA', value FROM deduped)"""
_EVAL = """v AS (SELECT doc_id // 10 AS question_id, quality AS verdict, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS rank FROM labels),
p AS (SELECT *, sum(verdict) OVER (PARTITION BY question_id ORDER BY rank) / rank AS p FROM v),
scores AS (SELECT question_id, round(sum(p * verdict) / nullif(sum(verdict), 0), 6) AS context_precision, round(avg(verdict), 6) AS context_recall FROM p
  GROUP BY question_id)"""
_USERS = "users AS (SELECT c_custkey, regexp_replace(c_name, '#', '.', 'g') || '@Example.com' AS email, coalesce(c_acctbal < 0, false) AS disabled FROM customer)"
#: Lines of pages of lessons; the blank line behind each page is the last, whatever the page has.
_LESSON_LINES = r"""pg AS (SELECT p.*, source, text, CASE WHEN lesson_id = 'Ngoai_TOC' THEN 'Phần ngoài mục lục' ELSE 'Lesson ' || CAST(substr(lesson_id,
  8) AS INTEGER) END AS whole FROM paged p JOIN documents USING (doc_id)),
cut AS (SELECT *, regexp_replace(unnest(string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')), '^\s+|\s+$', '', 'g') AS line,
  generate_subscripts(string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), 1) AS ord FROM pg),
lines AS (SELECT doc_id, page_number, lesson_id, source, whole, line, ord FROM cut WHERE line <> '' UNION ALL SELECT doc_id, page_number, lesson_id, source, whole,
  '', 1000000000 FROM pg)"""
_BLOCKS = r"""numbered AS (SELECT *, doc_id * 2000000000 + ord AS spot, sum(CAST(heading AS INTEGER)) OVER (PARTITION BY source, lesson_id ORDER BY doc_id,
  ord ROWS UNBOUNDED PRECEDING) AS block FROM headed),
blocks AS (SELECT source, lesson_id, block, any_value(whole) AS whole, CASE WHEN arg_min(heading, spot) THEN arg_min(title, spot) ELSE any_value(whole) END AS section,
 regexp_replace(string_agg(line, chr(10) ORDER BY spot), '^\s+|\s+$', '', 'g') AS text, list_sort(list(DISTINCT page_number) FILTER (line <> '')) AS pages,
  min(doc_id) AS first FROM numbered GROUP BY source, lesson_id, block)"""
_CHUNKS = r"""bl AS (SELECT source, lesson_id, block, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord
  FROM blocks WHERE text <> ''),
walk AS (SELECT source, lesson_id, block, ord, 0 AS piece, length(line) AS n FROM bl WHERE ord = 1
 UNION ALL SELECT w.source, w.lesson_id, w.block, l.ord, CASE WHEN w.n + length(l.line) + 2 <= 500 THEN w.piece ELSE w.piece + 1 END, CASE
  WHEN w.n + length(l.line) + 2 <= 500 THEN w.n + length(l.line) + 1 ELSE length(l.line) END
 FROM walk w JOIN bl l ON l.source = w.source AND l.lesson_id = w.lesson_id AND l.block = w.block AND l.ord = w.ord + 1),
packed AS (SELECT w.source, w.lesson_id, w.block, CASE WHEN length(b.text) <= 500 THEN 0 ELSE piece END AS piece, w.ord, line, section, whole, pages, first
 FROM walk w JOIN bl l USING (source, lesson_id, block, ord) JOIN blocks b USING (source, lesson_id, block)),
bodies AS (SELECT source, lesson_id, block, piece, any_value(section) AS section, any_value(whole) AS whole, any_value(pages) AS pages, any_value(first) AS first,
  regexp_replace(string_agg(line, chr(10) ORDER BY ord), '^\s+|\s+$', '', 'g') AS body FROM packed GROUP BY ALL),
kept AS (SELECT *, min(first) OVER (PARTITION BY source, lesson_id) AS started FROM bodies WHERE body <> ''),
counted AS (SELECT *, row_number() OVER (PARTITION BY source, lesson_id ORDER BY block, piece) AS i, row_number() OVER (PARTITION BY source ORDER BY started,
  lesson_id, block, piece) AS g FROM kept),
labelled AS (SELECT *, CASE len(pages) WHEN 1 THEN CAST(pages[1] AS VARCHAR) ELSE pages[1] || '-' || pages[-1] END AS label FROM counted)"""

SQL = {
    "html_comment_strip": "SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS body FROM pages",
    "page_marker_split": r"""WITH m AS (SELECT doc_id, 'lost <!-- OCR_PAGE: ' || doc_id % 210 || ' -->' || chr(10) || replace(text, chr(10),
  chr(10) || '<!-- ocr_page:7-->  <!-- note -->') AS text FROM documents),
s AS (SELECT doc_id, string_split_regex(text, '(?i)<!--\s*OCR_PAGE:\s*\d+\s*-->')[2:] AS parts, regexp_extract_all(text, '(?i)<!--\s*OCR_PAGE:\s*(\d+)\s*-->',
  1) AS ns FROM m),
u AS (SELECT doc_id, unnest(parts) AS p, unnest(ns) AS n, generate_subscripts(parts, 1) - 1 AS ord FROM s),
c AS (SELECT doc_id, ord, CAST(n AS INTEGER) AS page_number, regexp_replace(regexp_replace(p, '(?s)<!--.*?-->', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM u)
SELECT doc_id, ord, page_number, length(t) AS n_chars, md5(t) AS hash FROM c""",
    "reading_order": f"WITH {_LINES}, {_BOXES} SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY t, l, ord) AS position FROM boxes",
    "page_confidence": f"""WITH {_LINES}, {_BOXES} SELECT doc_id, md5(coalesce(string_agg(text, chr(10) ORDER BY t, l, ord) FILTER (text <> ''), '')) AS hash,
  round(avg(score), 4) AS avg_confidence FROM boxes GROUP BY doc_id""",
    "toc_interval_join": f"WITH {_TOC}, {_PAGES} SELECT doc_id, page_number, lesson_id FROM paged",
    "out_of_toc_pages": f"WITH {_TOC}, {_PAGES} SELECT page_number, count(*) AS n FROM paged WHERE lesson_id = 'Ngoai_TOC' GROUP BY page_number",
    "section_headings": f"WITH {_LINES}, {_HEAD} SELECT doc_id, ord, title FROM headed WHERE heading",
    "accent_fold": "SELECT doc_id, md5(trim(regexp_replace(lower(translate(strip_accents(text), 'Đđ', 'Dd')), '[^a-z0-9]+', ' ', 'g'))) AS hash FROM documents",
    "section_blocks": f"""WITH {_TOC}, {_PAGES}, {_LESSON_LINES}, {_HEAD}, {_BLOCKS} SELECT source, lesson_id, section, array_to_string(pages, ',') AS pages,
  first, md5(text) AS hash FROM blocks WHERE text <> ''""",
    "toc_chunks": f"""WITH RECURSIVE {_TOC}, {_PAGES}, {_LESSON_LINES}, {_HEAD}, {_BLOCKS}, {_CHUNKS}
SELECT source, lesson_id, source || ':' || lesson_id || ':' || printf('%04d', i) AS chunk_id, i AS chunk_index, g AS global_chunk_index, section, label AS source_pages,
 md5('# ' || whole || chr(10) || chr(10) || CASE WHEN section <> whole THEN '## ' || section || chr(10) || chr(10)
  ELSE '' END || '<!-- source_pages: ' || label || ' -->' || chr(10) || chr(10) || body) AS hash FROM labelled""",
    "legacy_chunks": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord,
  len(string_split(text, chr(10))) AS n FROM documents),
 own AS (SELECT *, ord > 1 OR regexp_matches(line, '^#{1,3}\s') OR n > 1 AND regexp_matches(line, '^#{1,3}$') AS starts FROM l),
 parts AS (SELECT doc_id, 0 AS ord, 'Bài ' || doc_id AS section, '# Bài ' || doc_id || CASE WHEN starts THEN '' ELSE chr(10) || line END AS t FROM own WHERE ord = 1
 UNION ALL SELECT doc_id, ord, CASE WHEN ord > 1 THEN line ELSE regexp_replace(line, '^#{1,3}\s*', '') END, CASE WHEN ord > 1 THEN '## ' || line ELSE line END
  FROM own WHERE starts),
 named AS (SELECT doc_id, ord, regexp_replace(section, '^\s+|\s+$', '', 'g') AS section, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM parts),
 titled AS (SELECT doc_id, ord, t, CASE WHEN section = '' THEN 'Nội dung' ELSE section END AS section FROM named),
 j AS (SELECT *, row_number() OVER w AS idx, last_value(CASE WHEN regexp_matches(lower(translate(strip_accents(section), 'Đđ', 'Dd')),
  'bai|chuong|phan') THEN section END IGNORE NULLS) OVER w AS lesson FROM titled WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
 SELECT doc_id, doc_id || ':legacy:' || printf('%04d', idx) AS chunk_id, CAST(idx AS INTEGER) AS idx, CAST(doc_id AS INTEGER) AS grade, md5(section) AS section,
  md5(lesson) AS lesson, md5(t) AS hash FROM j""",
    "objective_dedupe": r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS v, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
 k AS (SELECT *, trim(regexp_replace(lower(translate(strip_accents(v), 'Đđ', 'Dd')), '[^a-z0-9]+', ' ', 'g')) AS key FROM w),
 f AS (SELECT doc_id, arg_min(v, pos) AS v, min(pos) AS pos FROM k GROUP BY doc_id, key)
 SELECT doc_id, string_agg(v, ' ' ORDER BY pos) AS kept FROM f GROUP BY doc_id""",
    "greedy_pack": f"""WITH RECURSIVE {_LINES},
walk AS (SELECT doc_id, ord, 0 AS piece, length(line) AS n FROM lines WHERE ord = 0
 UNION ALL SELECT w.doc_id, l.ord, CASE WHEN w.n + length(l.line) + 2 <= 500 THEN w.piece ELSE w.piece + 1 END, CASE
  WHEN w.n + length(l.line) + 2 <= 500 THEN w.n + length(l.line) + 1 ELSE length(l.line) END
 FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.ord = w.ord + 1),
whole AS (SELECT doc_id FROM documents WHERE length(text) <= 500),
packed AS (SELECT w.doc_id, CASE WHEN w.doc_id IN (SELECT doc_id FROM whole) THEN 0 ELSE piece END AS piece, w.ord, line FROM walk w
  JOIN lines l ON w.doc_id = l.doc_id AND w.ord = l.ord),
t AS (SELECT doc_id, piece, string_agg(line, chr(10) ORDER BY ord) AS t FROM packed GROUP BY doc_id, piece)
SELECT doc_id, piece, length(t) AS n_chars, md5(t) AS hash FROM t""",
    "resume_pending": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "chunk_upsert": f"WITH {_UPSERT} SELECT * FROM merged",
    "purge_inactive": f"WITH {_UPSERT} SELECT * FROM merged WHERE active OR source NOT IN ('src1', 'src2', 'src3')",
    "lesson_merge": """WITH n AS (SELECT 'l' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN source || ',' || lang ELSE '' END AS o FROM documents WHERE doc_id % 3 <> 0),
o AS (SELECT 'l' || doc_id AS id, CASE WHEN doc_id % 7 <> 0 THEN 'old' END AS title, CASE WHEN doc_id % 4 = 0 THEN 'hand' ELSE 'ocr:x' END AS source,
  doc_id % 11 = 0 AS reviewed FROM documents WHERE doc_id % 5 <> 0),
j AS (SELECT coalesce(o.id, n.id) AS lesson_id, o.id IS NULL AS fresh, coalesce(n.o <> '' AND NOT o.reviewed AND starts_with(o.source, 'ocr'), false) AS machine,
  o.title, o.source, o.reviewed, n.o FROM n FULL OUTER JOIN o ON n.id = o.id)
SELECT lesson_id, CASE WHEN fresh THEN 'new' ELSE title END AS title, CASE WHEN fresh OR machine THEN o ELSE 'kept' END AS objectives, CASE WHEN fresh
  OR machine THEN 'ocr:auto' ELSE source END AS source, CASE WHEN fresh OR machine THEN false ELSE reviewed END AS reviewed FROM j""",
    "url_rewrite": """SELECT page_id, md5(replace(replace(html, '/The', 'https://img.example/1.png'), '/and', 'https://img.example/2.png')) AS hash FROM pages
  WHERE contains(html, '/The') OR contains(html, '/and')""",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "json_repair": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "entity_lists": """SELECT doc_id, 'a,' || lang AS khai_niem_dinh_nghia, '' AS cau_truc_chuc_nang, source AS co_che_qua_trinh, '' AS thi_nghiem_chung_minh,
  '' AS ung_dung_thanh_tuu, CAST(doc_id AS VARCHAR) AS y_nghia_sinh_hoc, '' AS tom_tat_cot_loi FROM documents""",
    "secret_redact": r"""SELECT doc_id, md5(replace(regexp_replace(text, '[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[a-z]+|AIza[0-9A-Za-z_-]{10,}', '[REDACTED]', 'g'),
  'Licensed', '[REDACTED]')) AS hash FROM documents""",
    "text_preview": r"WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^a-zA-Z \n]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(left(t, 120)) || '...' END AS preview FROM t",
    "entity_dedupe": f"WITH {_VALUES} SELECT doc_id, pos, value FROM deduped",
    "graph_nodes": f"WITH {_VALUES} SELECT value AS key, count(*) AS mentions, max(doc_id) AS doc_id, 'KhaiNiemV2' AS label FROM deduped GROUP BY value",
    "graph_edges": f"WITH {_VALUES}, {_EDGES} SELECT * FROM edges",
    "concept_degree": f"WITH {_VALUES}, {_EDGES} SELECT dst, count(*) AS degree FROM edges WHERE type = 'DINH_NGHIA' GROUP BY dst",
    "embed_pending": "SELECT doc_id, n_chars FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "vector_topk": f"WITH {_VECTOR} SELECT query_id, chunk_id, score, rank FROM vtop",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM btop",
    "hybrid_retrieve": f"""WITH {_BM25}, hv AS (SELECT query_id, vec_id AS chunk_id, round(list_dot_product(embedding::DOUBLE[],
  q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS score FROM (SELECT e.* FROM embeddings e
  JOIN documents d ON e.vec_id = d.doc_id) e, hq),
hvt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hv) WHERE rank <= 10),
both_ AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.chunk_id, b.chunk_id) AS chunk_id, v.rank AS vr, b.rank AS br FROM hvt v FULL OUTER
  JOIN btop b ON v.query_id = b.query_id AND v.chunk_id = b.chunk_id),
fused AS (SELECT *, coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + br), 0) AS raw FROM both_),
ranked AS (SELECT query_id, chunk_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vr ASC NULLS LAST,
  br ASC NULLS LAST) AS rank FROM fused)
SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 3""",
    "graph_expand": f"""WITH {_VECTOR}, {_VALUES}, c AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT value)), ',') AS concepts FROM deduped
  GROUP BY doc_id) SELECT query_id, chunk_id, source, score, concepts FROM vtop JOIN documents d ON chunk_id = d.doc_id LEFT JOIN c ON chunk_id = c.doc_id""",
    "rerank_threshold": f"""WITH {_VECTOR}, s AS (SELECT query_id, chunk_id, round(score - CASE WHEN query_id % 100 = 0 THEN 2.0 ELSE 0.3 END, 6) AS score
  FROM vtop), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, score, rank
  FROM r WHERE rank <= 5 AND (score >= 0.05 OR rank = 1)""",
    "context_assembly": f"""WITH {_VECTOR} SELECT query_id,
  md5(string_agg('--- Nguồn ' || rank || ' (Bài: ' || source || ') ---' || chr(10) || text || chr(10) || chr(10), '' ORDER BY rank)) AS hash FROM vtop
  JOIN documents ON chunk_id = doc_id WHERE rank <= 3 GROUP BY query_id""",
    "verify_defaults": "SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 4 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM events",
    "chat_cooldown": """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, ts AS last, true AS ok FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE
  WHEN e.ts - w.last >= INTERVAL 6 HOUR THEN e.ts ELSE w.last END, e.ts - w.last >= INTERVAL 6 HOUR FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, event_id FROM w WHERE ok""",
    "history_list": """SELECT conv_id, min_by(CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END, turn) AS title, max(turn) AS last_turn
  FROM conversations GROUP BY conv_id""",
    "session_get": "SELECT turn, role, text FROM conversations WHERE conv_id = 7",
    "session_delete": "SELECT role, count(*) AS n FROM conversations WHERE conv_id <> 7 GROUP BY role",
    "push_messages": """SELECT conv_id AS session_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(text, chr(10) ORDER BY turn)) AS hash FROM conversations
  WHERE conv_id % 10 <> 3 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn < 2) GROUP BY conv_id""",
    "user_search": f"WITH {_USERS} SELECT c_custkey, email FROM users WHERE contains(lower(email), '99@example')",
    "user_page": f"WITH {_USERS} SELECT c_custkey, email, 'user' AS role, disabled FROM users ORDER BY c_custkey LIMIT 1000",
    "role_update": f"""WITH {_USERS} SELECT CASE WHEN regexp_matches(lower(email), '^customer\\.0000000([0-5][0-9])@')
  AND lower(email) NOT IN ('customer.000000000@example.com', 'customer.000000001@example.com') THEN 'admin' ELSE 'user' END AS role, count(*) AS n FROM users
  GROUP BY 1""",
    "source_title": """SELECT doc_id, 'Nguồn ' || doc_id || ': ' || source || CASE WHEN lang <> 'en' THEN ' - ' || lang
  ELSE '' END || ' (Trang ' || doc_id % 210 || ', ' || doc_id % 210 + 1 || ')' AS title FROM documents""",
    "eval_precision_recall": f"WITH {_EVAL} SELECT * FROM scores",
    "eval_summary": f"""WITH {_EVAL} SELECT count(*) AS n, round(avg(context_precision), 4) AS context_precision, round(avg(context_recall),
  4) AS context_recall FROM scores""",
    "eval_resume": """SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'ERROR' ELSE 'PENDING' END AS status FROM documents d LEFT
  JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR toxic = 1""",
}
SQL |= services.SQL
SQL["chat_cooldown_stream"] = SQL["chat_cooldown"]
