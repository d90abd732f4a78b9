"""SQL of the recursive splitter: pieces by separator, level by level, and runs of short pieces packed by a recursion.

A text is cut at the first separator that it holds; pieces of `size` characters and more are cut again by the finer
ones. Neighbouring short pieces are a run, whose cuts are packed chunk by chunk.
"""

from __future__ import annotations

LEVELS = (1, 2, 3, 4)
#: White space at the ends of a chunk.
WHITE = r"[\s\p{Z}\x1c-\x1f\x85\x0b]"


def _pieces(k: int, size: int) -> str:
    """From unit{k}(doc_id, unit, a, body, least): the pieces of each unit, with their places in the text."""
    return f"""level{k} AS (
  SELECT *, CASE WHEN least <= 1 AND contains(body, chr(10) || chr(10)) THEN 1
    WHEN least <= 2 AND contains(body, chr(10)) THEN 2 WHEN least <= 3 AND contains(body, ' ') THEN 3 ELSE 4 END AS level
  FROM unit{k}
), cut{k} AS (
  SELECT doc_id, unit, a, level, sep, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
  FROM (SELECT *, CASE level WHEN 1 THEN chr(10) || chr(10) WHEN 2 THEN chr(10) ELSE ' ' END AS sep,
          string_split(body, sep) AS parts
        FROM level{k} WHERE level < 4)
  UNION ALL
  SELECT doc_id, unit, a, 4, '', unnest(list_transform(range(1, length(body) + 1), lambda i: substr(body, i, 1))),
    unnest(range(1, length(body) + 1))
  FROM level{k} WHERE level = 4
), piece{k} AS (
  SELECT doc_id, unit, level, piece, a + (sum(length(piece)) OVER w)::BIGINT - length(piece) AS a,
    a + (sum(length(piece)) OVER w)::BIGINT AS b, level = 4 OR length(piece) < {size} AS short,
    count(*) FILTER (level < 4 AND length(piece) >= {size}) OVER w AS before
  FROM (SELECT doc_id, unit, a, level, i, CASE WHEN i > 1 THEN sep ELSE '' END || part AS piece FROM cut{k})
  WHERE piece <> ''
  WINDOW w AS (PARTITION BY doc_id, unit ORDER BY i ROWS UNBOUNDED PRECEDING)
), unit{k + 1} AS (
  SELECT doc_id, unit || '.' || a AS unit, a, piece AS body, level + 1 AS least FROM piece{k} WHERE NOT short
)"""


def _first(condition: str) -> str:
    """The first place of the list of cuts that meets a condition on (x, i)."""
    return f"list_position(list_transform(cuts, lambda x, i: {condition}), true)"


def recursive_sql(size: int, overlap: int) -> str:
    """(doc_id, chunk_no, n_chars, text_md5) of all chunks of `documents`."""
    short = " UNION ALL ".join(f"SELECT doc_id, unit, before, a, b FROM piece{k} WHERE short" for k in LEVELS)
    kept = _first(f"i >= l AND cuts[r - 1] - x <= {overlap} AND cuts[r] - x <= {size}")
    return f"""WITH RECURSIVE unit1 AS (
  SELECT doc_id, '' AS unit, 0 AS a, text AS body, 1 AS least FROM documents WHERE length(text) > 0
), {", ".join(_pieces(k, size) for k in LEVELS)}, run AS (
  SELECT doc_id, unit, before, list_prepend(min(a), list(b ORDER BY a)) AS cuts FROM ({short})
  GROUP BY doc_id, unit, before
), pack AS (
  SELECT doc_id, cuts, 1::BIGINT AS l, {_first(f"x - cuts[1] > {size}")}::BIGINT AS r FROM run
  UNION ALL
  SELECT doc_id, cuts, n, {_first(f"x - cuts[n] > {size}")}::BIGINT
  FROM (SELECT doc_id, cuts, least(r - 1, coalesce({kept}, r - 1))::BIGINT AS n FROM pack WHERE r IS NOT NULL)
), span AS (
  SELECT doc_id, cuts[l] AS a, CASE WHEN r IS NULL THEN cuts[len(cuts)] ELSE cuts[r - 1] END AS b
  FROM pack WHERE l < coalesce(r - 1, len(cuts))
), chunk AS (
  SELECT doc_id, a, regexp_replace(regexp_replace(substr(text, a + 1, b - a), '^{WHITE}+', ''), '{WHITE}+$', '') AS chunk
  FROM span JOIN documents USING (doc_id)
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INTEGER AS chunk_no, length(chunk) AS n_chars,
  md5(chunk) AS text_md5
FROM chunk WHERE chunk <> ''"""
