"""op12: codes of every embedding."""

from pyspark.sql import functions as F

from driftline.llm.registry import query
from driftline.llm.tables import write
from driftline.llm.vector_codes import ENTRIES, GRID, PARTS, ROUNDS, compress, digest, with_label_error
from driftline.session import table

_NEAREST = """a{r} AS (
    SELECT k, p, min_by(e, d * {entries} + e) AS e, min(d) AS d
    FROM (SELECT x.k, x.p, b.e, list_sum(list_transform(range(1, len(x.g) + 1), lambda i: (x.g[i] - b.g[i]) * (x.g[i] - b.g[i])))::BIGINT AS d FROM x JOIN b{r} b ON x.p = b.p)
    GROUP BY k, p)"""
_BOOK = """m{r} AS (
    SELECT p, e, i, (s - ((s % n) + n) % n) // n AS v
    FROM (SELECT a.p, a.e, u.i, sum(x.g[u.i])::BIGINT AS s, count(*) AS n FROM a{q} a JOIN x ON a.k = x.k AND a.p = x.p, LATERAL (SELECT unnest(range(1, len(x.g) + 1)) AS i) u GROUP BY ALL)),
n{r} AS (SELECT p, e, list(v ORDER BY i) AS g FROM m{r} GROUP BY p, e),
b{r} AS (SELECT b.p, b.e, coalesce(n.g, b.g) AS g FROM b{q} b LEFT JOIN n{r} n ON b.p = n.p AND b.e = n.e)"""

SQL = f"""
WITH kept AS (
    SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id, embedding) AS k
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (
    SELECT k, p, list_transform(range(1, len(v) // {PARTS} + 1), lambda i: floor({GRID} * v[p * (len(v) // {PARTS}) + i]::DOUBLE)::BIGINT) AS g
    FROM kept, (SELECT unnest(range({PARTS})) AS p)),
b0 AS (SELECT p, k - 1 AS e, g FROM x WHERE k <= {ENTRIES}),
{_NEAREST.format(r=0, entries=ENTRIES)},
{", ".join(_BOOK.format(r=r, q=r - 1) + ", " + _NEAREST.format(r=r, entries=ENTRIES) for r in range(1, ROUNDS + 1))},
coded AS (SELECT k, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY k),
whole AS (SELECT sha256(string_agg(array_to_string(g, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (k), whole
"""


@query("op12_vector_codes", SQL)
def op12_vector_codes(spark, sf_dir):
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    done = with_label_error(write(coded, "coded")[0])
    return done.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books[-1])).alias("codebooks_sha256"))
