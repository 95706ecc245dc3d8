"""DuckDB SQL for the queries that SQL expresses over whole tables."""

from __future__ import annotations

from carelake.llm.oracle_turns import REPAIR, TRIE

OP4 = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""


OP5 = r"""
WITH t AS (
  SELECT conv_id, coalesce(floor(turn / 256.0), 0)::BIGINT AS part, turn, role,
         replace(coalesce(text, ''), '<|im_', '<| im_') AS text, row_number() OVER () AS n
  FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), h AS (
  SELECT t.*, perspective, coalesce(role = perspective, false) AS own,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant'
           ELSE 'user name=' || regexp_replace(coalesce(role, 'unknown'), '[^\p{L}\p{N}_-]', '_', 'g') END
         || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 11) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              + length(head) AS begin
  FROM h WINDOW w AS (PARTITION BY conv_id, perspective, part
                      ORDER BY turn NULLS FIRST, role NULLS FIRST, text, n)
)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY begin) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN begin || ':' || begin + length(text) + 10 END, ',' ORDER BY begin), '')
         AS mask
FROM o GROUP BY conv_id, perspective, part
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS draw
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS most,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source
), v AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY most / weight, place)
), l AS (
  SELECT min_by(level, (most / weight, place)) AS level FROM v WHERE most / weight >= level
), t AS (
  SELECT source, source_size, least(most, coalesce((SELECT level FROM l), 0) * weight) AS target FROM s
), u AS (
  SELECT t.*, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.*, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS rest,
         left(draw, 3) AS block
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), b AS (
  SELECT source, block, sum(size) AS words,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY block
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r GROUP BY source, block
), k AS (
  SELECT r.source, r.block, r.draw, b.before
         + coalesce(sum(sum(r.size)) OVER (PARTITION BY r.source, r.block ORDER BY r.draw
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(r.size) / 2.0 AS middle
  FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source AND r.block = b.block
  GROUP BY r.source, r.block, r.draw, b.before
)
SELECT r.doc_id, r.size::BIGINT AS size, r.source_size, r.target,
       (r.size * (r.whole + CASE WHEN b.before + b.words <= r.rest THEN 1
                                 WHEN b.before < r.rest AND k.middle <= r.rest THEN 1 ELSE 0 END))::BIGINT AS taken,
       r.source
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source AND r.block = b.block
       JOIN k ON r.source IS NOT DISTINCT FROM k.source AND r.draw = k.draw
"""


OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * shared >= 90 * (i.n + j.n - shared)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id AS root, doc_id FROM documents UNION SELECT r.root, e.y FROM r JOIN e ON e.x = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), k AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos, w FROM d WHERE len(w) >= 50
), h AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 49], ' ')) AS h FROM k
), f AS (
  SELECT h, min(doc_id) AS first FROM h GROUP BY h
), g AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM h JOIN f USING (h) WHERE first < doc_id
), l AS (
  SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id
), r AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE
         list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])),
                        lambda x: x[1]) END AS kept
  FROM d LEFT JOIN l USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM r
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), u AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(list_transform(w, lambda z: length(z))) AS chars FROM d
), k AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2),
         lambda i: md5(array_to_string(w[i:i + n - 1], ' ')))) AS gram
  FROM d, (SELECT unnest(range(5, 11)) AS n) WHERE len(w) >= n
), h AS (
  SELECT doc_id, n, pos, count(*) OVER (PARTITION BY doc_id, n, gram) AS times FROM k
), c AS (
  SELECT DISTINCT doc_id, n, unnest(range(pos, pos + n)) AS pos FROM h WHERE times > 1
), m AS (
  SELECT doc_id, count(*) FILTER (n = 5) AS n_repeat_words, FIELDS
  FROM c JOIN u USING (doc_id, pos) GROUP BY doc_id
), x AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), y AS (
  SELECT doc_id, line, count(*) - 1 AS extra, list_sum(list_transform(
         regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda z: length(z))) AS chars
  FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
), z AS (
  SELECT doc_id, sum(extra) AS n_dup_lines, sum(extra * chars) AS dup_line_chars FROM y GROUP BY doc_id
), a AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda z: length(z))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, coalesce(n_repeat_words, 0) AS n_repeat_words, COALESCED
  FROM d LEFT JOIN m USING (doc_id) LEFT JOIN z USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * dup_line_chars > 30 * word_chars
            OR LIMITS) AS kept
FROM a
"""
# Limits of the coverage, written out for the SQL side: 20 % for 5-word windows down to 15 % for 10-word windows.
for name, item, glue in (
    ("FIELDS", "sum(chars) FILTER (n = {n}) AS repeat_chars_{n}", ", "),
    ("COALESCED", "coalesce(repeat_chars_{n}, 0)::BIGINT AS repeat_chars_{n}", ", "),
    ("LIMITS", "100 * repeat_chars_{n} > {most} * word_chars", " OR "),
):
    OP10 = OP10.replace(name, glue.join(item.format(n=n, most=25 - n) for n in range(5, 11)))


def sql_queries() -> dict[str, str]:
    return {"op3_ngram_join": OP3, "op8_substring_dedup": OP8, "op10_quality_rules": OP10, "op4_exact_dedup": OP4,
            "op5_chat_rotation": OP5, "op7_source_mixing": OP7, "op11_prefix_trie": TRIE,
            "op13_structure_repair": REPAIR}
