"""DuckDB SQL of the operators on conversations: the trie (11) and the repair (13)."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII expression, bit by bit."""
    bits = f"list_transform(range(8 * length({text})), lambda k: (ascii(substr({text}, k // 8 + 1, 1)) >> (k % 8)) & 1)"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}::BIGINT[]), "
            "lambda x, bit: xor(x >> 1, (xor(x, bit) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT)")


TRIE = rf"""
WITH said AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, md5(length(r) || ':' || r || x) AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS pos
  FROM said),
members AS (SELECT DISTINCT c, c - c % 20 AS base, {_crc32("c::VARCHAR")} % 4 AS h FROM own),
built AS (
  SELECT m.c, 0 AS part, o.pos, o.k, o.w FROM members m JOIN own o ON o.c = m.base AND o.pos <= m.h
  UNION ALL SELECT m.c, 1, o.pos, o.k, o.w FROM members m JOIN own o ON o.c = m.c AND o.pos > m.h),
steps AS (
  SELECT c, row_number() OVER o AS d, w, string_agg(k, '') OVER o AS path FROM built
  WINDOW o AS (PARTITION BY c ORDER BY part, pos)
  UNION ALL SELECT c, 0, 0, '' FROM members),
nodes AS (SELECT path, d, min(c) AS conv, count(*) AS n FROM steps GROUP BY path, d),
children AS (SELECT substr(path, 1, (d - 1) * 32) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
leaves AS (
  SELECT s.path, count(*) AS n
  FROM steps s JOIN nodes l ON l.conv = s.c AND s.d <= l.d AND starts_with(l.path, s.path)
  WHERE l.path NOT IN (SELECT path FROM children) GROUP BY s.path),
saved AS (
  SELECT path, sum(tail) AS n FROM (
    SELECT s.path, sum(CASE WHEN s.c = n.conv THEN 0 ELSE s.w END) OVER (PARTITION BY s.c ORDER BY s.d DESC) AS tail
    FROM steps s JOIN nodes n USING (path)) GROUP BY path),
ends AS (
  SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS digest
  FROM (SELECT c, arg_max(path, d) AS path FROM steps GROUP BY c) GROUP BY path)
SELECT n.conv AS conv_id, n.d AS depth, up.conv AS parent_conv_id, n.n AS n_convs, coalesce(ch.n, 0) AS n_children,
       l.n AS n_leaves, s.n::BIGINT AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes up ON n.d > 0 AND up.path = substr(n.path, 1, (n.d - 1) * 32)
LEFT JOIN children ch ON ch.path = n.path JOIN leaves l ON l.path = n.path JOIN saved s ON s.path = n.path
LEFT JOIN ends e ON e.path = n.path
"""

# Due role and next state of each state: nothing yet, system said, user said, assistant said.
_DUE = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
_KEEP = [[("s", 1), ("u", 2)], [("u", 2)], [("a", 3)], [("u", 2)]]


def _edit(cost: str, letter: str, said: str, after: str) -> str:
    return f"{{'c': {cost} + {after}.c, 'a': '{letter}' || {after}.a, 'r': {said} || {after}.r}}"


def _inserted(state: int, after: str) -> str:
    return _edit("2", "I", f"chr(10) || '{_DUE[state][0]}:'", after)


def _row(state: int) -> str:
    """Cheapest edit of a row in a state, of those behind it v0 to v3."""
    role, due = _DUE[state]
    free = "CASE WHEN gone THEN 1000000 ELSE {} + open END"
    kinds = [_edit("3", "D", "''", f"v{state}"), _edit(free.format(2), "R", f"chr(10) || '{role}:' || text", f"v{due}")]
    kinds += [_edit(f"CASE WHEN gone OR initial <> '{x}' THEN 1000000 ELSE open END", "K",
                    "chr(10) || role || ':' || text", f"v{to}") for x, to in _KEEP[state]]
    return f"list_sort([{', '.join(kinds)}])[1] AS b{state}"


_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
_START = ", ".join(f"{{'c': {c}, 'a': '{a}', 'r': {r}}} AS v{i}" for i, (c, a, r) in enumerate([
    (0, "", "''"), (4, "II", "chr(10) || 'user:' || chr(10) || 'assistant:'"), (2, "I", "chr(10) || 'assistant:'"),
    (0, "", "''")]))

REPAIR = rf"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(f"({_KEY})")} % 20 AS kind
  FROM conversations),
after AS (
  SELECT conv_id AS c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE kind <> 0),
placed AS (
  SELECT c, turn, role, text, left(role, 1) AS initial, row_number() OVER o AS pos,
         lead(left(role, 1)) OVER o AS following, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) IN ('.', '!', '?') AS shut
  FROM after WINDOW o AS (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy)),
faults AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 AS dup FROM placed),
rows_ AS (
  SELECT *, blank OR dup AS gone, CASE WHEN NOT blank AND NOT dup AND NOT shut THEN 1 ELSE 0 END AS open FROM faults),
walk AS (
  SELECT c, max(pos) AS i, {_START} FROM rows_ GROUP BY c
  UNION ALL
  SELECT c, i, list_sort([b0, {_inserted(0, "n2")}])[1], list_sort([b1, {_inserted(1, "n2")}])[1], n2, n3
  FROM (
    SELECT c, i, b0, b1, list_sort([b2, {_inserted(2, "b3")}])[1] AS n2, list_sort([b3, {_inserted(3, "b2")}])[1] AS n3
    FROM (SELECT w.c, w.i - 1 AS i, {", ".join(_row(s) for s in range(4))}
          FROM walk w JOIN rows_ r ON w.c IS NOT DISTINCT FROM r.c AND w.i = r.pos))),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(dup) AS dup, sum(open)::BIGINT AS open,
         count_if(following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY c)
SELECT o.conv_id, coalesce(k.gaps, 0) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.dup, 0) AS duplicate,
       coalesce(k.open, 0) AS truncated, coalesce(k.illegal, 0) AS illegal, coalesce(w.v0.c, 0)::BIGINT AS cost,
       coalesce(w.v0.a, '') AS audit, sha256(coalesce(substr(w.v0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts k ON o.conv_id IS NOT DISTINCT FROM k.c
LEFT JOIN walk w ON o.conv_id IS NOT DISTINCT FROM w.c AND w.i = 0
"""
