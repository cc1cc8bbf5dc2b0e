"""op6: benchmark passages in every document."""

from pyspark.sql import functions as F

from driftline.llm.decontamination import find_matches
from driftline.llm.registry import query
from driftline.session import table

SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM
    (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
i AS (
  SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM
    (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark)),
n AS (SELECT item_id, w, least(len(w), 10) AS k FROM i WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, k, list_aggregate(w[j : j + k - 1], 'string_agg', ' ') AS s
      FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM n)),
e AS (SELECT doc_id, k, j, list_aggregate(w[j : j + k - 1], 'string_agg', ' ') AS s
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j
            FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, j, k FROM e JOIN q USING (k, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op6_decontamination", SQL)
def op6_decontamination(spark, sf_dir):
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
