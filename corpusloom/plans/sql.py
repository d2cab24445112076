"""The kb's tables in DuckDB's SQL, as common table expressions for the oracles."""

DOCS = """docs AS (
  SELECT 'doc-' || doc_id AS slug, 'Document ' || doc_id AS title, source || '/doc-' || doc_id || '.md' AS rel_path,
    source || '/File ' || doc_id || '.' || ['pdf', 'docx', 'csv', 'md', 'pptx'][(doc_id % 5 + 1)::INT] AS source_file, ['pdf', 'docx', 'csv', 'md', 'pptx'][(doc_id % 5 + 1)::INT] AS source_format,
    CASE WHEN doc_id % 3 = 0 THEN 'UNCONFIRMED' ELSE '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS doc_date,
    CASE WHEN doc_id % 7 = 0 THEN 'needs_ocr' WHEN doc_id % 7 = 1 THEN 'partial' ELSE 'clean' END AS text_class, length(text) AS chars, sha256(text) AS kb_sha256, text AS body, doc_id
  FROM documents)"""

BLOCKS = (
    DOCS
    + r""",
raw AS (SELECT slug, unnest(range(0, len(l))) AS pos, unnest(l) AS text FROM (SELECT slug, string_split(body, chr(10)) AS l FROM docs)),
num AS (SELECT slug, (row_number() OVER (PARTITION BY slug ORDER BY pos) - 1)::INT AS ordinal, text FROM raw WHERE regexp_matches(text, '[^\s\x{85}\x{A0}\x{3000}]')),
kinds AS (
  SELECT slug, ordinal, (ordinal // 20 + 1)::INT AS page,
    CASE WHEN contains(text, '|') THEN 'table' WHEN length(text) <= 60 THEN 'heading' WHEN starts_with(text, '- ') THEN 'list' ELSE 'paragraph' END AS kind, text
  FROM num),
blocks AS (
  SELECT slug, ordinal, page, kind, CASE WHEN kind = 'heading' THEN (1 + length(text) % 4)::INT END AS level, text,
    slug || ':p' || lpad(page::VARCHAR, greatest(3, length(page::VARCHAR))::INT, '0') || ':b' || lpad((row_number() OVER (PARTITION BY slug, page ORDER BY ordinal))::VARCHAR, 3, '0') AS block_id
  FROM kinds)"""
)

SECTIONS = (
    BLOCKS
    + r""",
h AS (SELECT *, coalesce(kind = 'heading' AND level <= 3, false) AS heads, trim(regexp_replace(text, '^#{1,6}\s*', '')) AS name FROM blocks),
o AS (SELECT *, heads AND NOT coalesce(lag(heads) OVER (PARTITION BY slug ORDER BY ordinal), false) AS opens, ordinal = 0 AS starts FROM h),
n AS (
  SELECT *, (sum((opens OR starts)::INT) OVER w - 1)::INT AS section_index, last_value(CASE WHEN opens THEN level END IGNORE NULLS) OVER w AS own
  FROM o WINDOW w AS (PARTITION BY slug ORDER BY ordinal ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, opens OR (heads AND level > own) AS event FROM n),
s AS (
  SELECT slug, section_index, coalesce(max(CASE WHEN opens THEN level END), 0)::INT AS level, max(CASE WHEN opens THEN name END) AS heading, min(ordinal) AS block_first, max(ordinal) AS block_last,
    min(page) AS page_first, max(page) AS page_last
  FROM e GROUP BY ALL),
p AS (
  SELECT s.slug, s.section_index, v.l,
    (SELECT max(ordinal) FROM e WHERE e.slug = s.slug AND e.ordinal <= s.block_last AND e.event AND e.level = v.l) AS at,
    (SELECT max(ordinal) FROM e WHERE e.slug = s.slug AND e.ordinal <= s.block_last AND e.opens AND e.level < v.l) AS cut
  FROM s, (VALUES (1), (2), (3)) AS v(l)),
q AS (SELECT p.slug, p.section_index, string_agg(e.name, ' › ' ORDER BY p.l) AS tail FROM p JOIN e ON e.slug = p.slug AND e.ordinal = p.at WHERE p.at > coalesce(p.cut, -1) GROUP BY ALL),
sections AS (
  SELECT s.slug, s.section_index, s.level, s.heading, CASE WHEN heading IS NULL THEN title ELSE title || coalesce(' › ' || tail, '') END AS heading_path, block_first, block_last, page_first, page_last
  FROM s JOIN docs USING (slug) LEFT JOIN q USING (slug, section_index))"""
)

CHUNKS = (
    SECTIONS
    + """,
pieces AS (
  SELECT slug, section_index, ordinal, page, text, length(text) AS size, kind, row_number() OVER (PARTITION BY slug, section_index ORDER BY ordinal) AS i,
    CASE WHEN kind = 'table' THEN 'T' WHEN kind IN ('paragraph', 'list') AND length(text) > 2500 THEN 'P' ELSE 'N' END AS role
  FROM n),
walk AS (
  SELECT slug, section_index, i, 0 AS cid, CASE WHEN role = 'P' THEN 0 ELSE size END AS held, role <> 'P' AS open_, role <> 'P' AND kind = 'heading' AS lone, role = 'T' AS tab, CASE WHEN role = 'P' THEN 1 ELSE 0 END AS after
  FROM pieces WHERE i = 1
  UNION ALL
  SELECT slug, section_index, i, cid, CASE WHEN role = 'P' THEN 0 WHEN shut OR NOT was THEN size ELSE held + 2 + size END, role <> 'P', role <> 'P' AND (shut OR NOT was) AND kind = 'heading', role = 'T', CASE WHEN role = 'P' THEN 1 ELSE 0 END
  FROM (
    SELECT *, w_cid + w_after + shut::INT AS cid FROM (
      SELECT p.*, w.cid AS w_cid, w.after AS w_after, w.held, w.open_ AS was, w.open_ AND (w.tab OR (p.role = 'T' AND NOT w.lone) OR p.role = 'P' OR (p.role = 'N' AND w.held + p.size > 1200)) AS shut
      FROM walk w JOIN pieces p ON p.slug = w.slug AND p.section_index = w.section_index AND p.i = w.i + 1))),
grouped AS (
  SELECT slug, section_index, cid, min(ordinal) AS block_first, max(ordinal) AS block_last, min(page) AS page_first, max(page) AS page_last, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS text
  FROM walk JOIN pieces USING (slug, section_index, i) GROUP BY ALL),
chunks AS (SELECT slug, (row_number() OVER (PARTITION BY slug ORDER BY section_index, cid) - 1)::INT AS chunk_index, section_index, block_first, block_last, page_first, page_last, text FROM grouped)"""
)
