"""op2: repeated lines of every document."""

from pyspark.sql import functions as F

from driftline.llm.line_dedup import dedup_lines
from driftline.llm.registry import query
from driftline.session import table

SQL = r"""
WITH l AS (
  SELECT doc_id, no, line, length(line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents)
  WHERE trim(line, ' ') <> ''),
d AS (SELECT line, n, min(doc_id * 1000000 + no) AS first FROM l GROUP BY 1, 2),
p AS (
  SELECT CASE WHEN a.first < b.first THEN b.line ELSE a.line END AS line
  FROM d AS a JOIN d AS b ON b.n BETWEEN a.n AND a.n + 2 AND (a.n < b.n OR a.first < b.first)
  WHERE b.n - a.n <= least(2, a.n // 5) AND a.n >= 5 AND levenshtein(a.line, b.line) <= least(2, a.n // 5)),
x AS (
  SELECT l.doc_id, l.no, l.line, trim(l.line, ' ') <> '' AND (d.first <> l.doc_id * 1000000 + l.no OR p.line IS NOT NULL) AS gone
  FROM l JOIN d USING (line) LEFT JOIN (SELECT DISTINCT line FROM p) AS p USING (line)),
k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, list(no) FILTER (gone) AS numbers FROM x GROUP BY 1)
SELECT f.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  array_to_string(list_filter(string_split(text, chr(10)), lambda s, i: NOT list_contains(coalesce(numbers, []), i - 1)), chr(10)) AS kept
FROM documents AS f LEFT JOIN k USING (doc_id)
"""


@query("op2_line_dedup", SQL)
def op2_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "kept")
