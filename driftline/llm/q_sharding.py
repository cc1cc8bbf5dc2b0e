"""op10: documents in shards of at most 1 MiB of text."""

from driftline.llm.registry import query
from driftline.llm.sharding import assign
from driftline.session import table

SHARD_BYTES = 1 << 20

SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h FROM documents),
x AS (SELECT doc_id, n_bytes, d, h >> (60 - d) AS q FROM r, range(0, 61) AS s(d)),
f AS (SELECT d, q FROM x GROUP BY d, q HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1),
m AS (SELECT doc_id, n_bytes, min(d)::INTEGER AS depth FROM x JOIN f USING (d, q) GROUP BY 1, 2)
SELECT doc_id, n_bytes, depth,
  CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(h >> (60 - depth)), 60, '0'), depth) END AS shard
FROM m JOIN r USING (doc_id, n_bytes)
"""


@query("op10_sharding", SQL)
def op10_sharding(spark, sf_dir):
    return assign(table(spark, sf_dir, "documents"), SHARD_BYTES)
