"""Object graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import graph as G
from driftline.plans.inputs import STATUS_SQL, status_board
from driftline.plans.q_sources import CASES_SQL, event_cases
from driftline.plans.registry import query


def graph_board(spark, sf):
    """Board rows with a belief value where the object is reliable."""
    return status_board(spark, sf).withColumn("belief", F.when(F.col("reliable"), F.col("score")))


def cases(spark, sf):
    return event_cases(spark, sf).select("id", F.explode("norad_ids").alias("norad_id"), "t_peak", "type", "sources")


def edges(spark, sf):
    b, c = graph_board(spark, sf), cases(spark, sf)
    return G.union_all([G.object_edges(b), G.peer_edges(b), G.case_edges(c)])


EDGE_SQL = f"""{STATUS_SQL}, {CASES_SQL}, al AS (SELECT *, is_anomaly OR is_detection OR status <> 'NOMINAL' AS alerting FROM sb),
  pr AS (SELECT norad_id, asset_norad, pair_risk, row_number() OVER (PARTITION BY asset_norad ORDER BY pair_risk DESC, norad_id) AS r FROM sb WHERE asset_norad IS NOT NULL),
  pe AS (SELECT a.norad_id, o.norad_id AS peer, row_number() OVER (PARTITION BY a.norad_id ORDER BY o.r) AS k FROM pr a JOIN pr o ON a.asset_norad = o.asset_norad AND a.norad_id <> o.norad_id),
  ow AS (SELECT norad_id, id, strftime(t_peak, '%Y-%m-%d') AS t_peak, type LIKE 'placebo%' AS is_placebo, row_number() OVER (PARTITION BY norad_id ORDER BY t_peak, id) AS k FROM cases),
  pl AS (SELECT norad_id, id, t_peak, row_number() OVER (PARTITION BY t_peak ORDER BY norad_id, id) AS r FROM cases WHERE type LIKE 'placebo%'),
  sp AS (SELECT c.norad_id, p.id AS pid, strftime(c.t_peak, '%Y-%m-%d') AS t_peak, row_number() OVER (PARTITION BY c.id, c.norad_id ORDER BY p.r) AS k FROM cases c JOIN pl p ON c.t_peak = p.t_peak AND c.norad_id <> p.norad_id),
  nm AS (SELECT norad_id, name FROM sb),
  ed AS (SELECT 'sat:' || norad_id AS src, 'sat:' || asset_norad AS dst, 'threatens' AS type, printf('%s risk %.2f', risk_level, pair_risk) AS label, pair_risk::DOUBLE AS pair_risk, pair_dist::DOUBLE AS distance_km, NULL::VARCHAR AS t_peak, NULL::BOOLEAN AS is_placebo FROM al WHERE asset_norad IS NOT NULL
   UNION ALL SELECT 'sat:' || norad_id, 'alert:' || norad_id, 'hasAlert', status, NULL, NULL, NULL, NULL FROM al WHERE alerting UNION ALL SELECT 'alert:' || norad_id, 'sat:' || norad_id, 'source', name, NULL, NULL, NULL, NULL FROM al WHERE alerting
   UNION ALL SELECT 'sat:' || norad_id, 'wx:' || norad_id, 'weather', 'daily index', NULL, NULL, NULL, NULL FROM al UNION ALL SELECT 'wx:' || norad_id, 'sat:' || norad_id, 'windowOf', name, NULL, NULL, NULL, NULL FROM al
   UNION ALL SELECT 'sat:' || norad_id, 'ev:' || norad_id, 'fusedAs', printf('Bel %.2f', score::DOUBLE), NULL, NULL, NULL, NULL FROM al WHERE reliable UNION ALL SELECT 'ev:' || norad_id, 'sat:' || norad_id, 'about', name, NULL, NULL, NULL, NULL FROM al WHERE reliable
   UNION ALL SELECT 'sat:' || pe.norad_id, 'sat:' || peer, 'sameAsset', nm.name, o.pair_risk, NULL, NULL, NULL FROM pe JOIN nm ON nm.norad_id = peer JOIN pr o ON o.norad_id = peer WHERE k <= 4
   UNION ALL SELECT 'sat:' || asset_norad, 'sat:' || pr.norad_id, 'threatenedBy', nm.name, pair_risk, NULL, NULL, NULL FROM pr JOIN nm ON nm.norad_id = pr.norad_id WHERE r <= 4 AND asset_norad IN (SELECT norad_id FROM sb WHERE role = 'asset')
   UNION ALL SELECT 'sat:' || norad_id, 'case:' || id, 'validatedBy', id, NULL, NULL, t_peak, is_placebo FROM ow WHERE k <= 3
   UNION ALL SELECT 'sat:' || norad_id, 'case:' || pid, 'samePeak', pid, NULL, NULL, t_peak, true FROM sp WHERE k <= 3)"""


@query("n1_object_edges", f"WITH {EDGE_SQL} SELECT src, dst, type, label, pair_risk, distance_km, t_peak, is_placebo FROM ed")
def n1(spark, sf):
    return edges(spark, sf).withColumn("t_peak", F.col("t_peak").cast("string"))


NODE_SQL = f"""{EDGE_SQL}, nd AS (SELECT 'sat:' || norad_id AS id, 'satellite' AS kind, name AS label, role, status, score::DOUBLE AS score FROM al UNION ALL SELECT 'alert:' || norad_id, 'alert', status, role, status, attention::DOUBLE FROM al WHERE alerting
   UNION ALL SELECT 'ev:' || norad_id, 'evidence', 'belief', NULL, NULL, score::DOUBLE FROM al WHERE reliable UNION ALL SELECT 'wx:' || norad_id, 'weather', 'daily index', NULL, NULL, NULL FROM al
   UNION ALL SELECT DISTINCT 'case:' || id, 'case', id, NULL, type, NULL FROM cases
   UNION ALL SELECT DISTINCT 'doc:' || regexp_replace(lower(s), '[^a-z0-9]', '-', 'g'), 'document', s, NULL, NULL, NULL FROM (SELECT unnest(sources) AS s FROM cases))"""


@query("n1_object_nodes", f"WITH {NODE_SQL} SELECT id, kind, label, role, status, round(score, 6) AS score FROM nd")
def n1n(spark, sf):
    return G.nodes(graph_board(spark, sf), cases(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    "n2_document_links",
    f"""WITH {CASES_SQL}, d AS (SELECT DISTINCT 'doc:' || regexp_replace(lower(s), '[^a-z0-9]', '-', 'g') AS src, 'case:' || id AS dst FROM (SELECT id, unnest(sources) AS s FROM cases))
    SELECT src, dst, unnest(['mentions', 'validatedBy']) AS type FROM d""",
)
def n2(spark, sf):
    return G.document_edges(cases(spark, sf))


@query(
    "n3_neighbourhood",
    f"""WITH RECURSIVE {EDGE_SQL}, e AS (SELECT DISTINCT src, dst FROM ed), s AS (SELECT DISTINCT 'sat:' || asset_norad AS start FROM sb WHERE asset_norad IS NOT NULL),
    rc AS (SELECT start, start AS id, 0 AS hop FROM s UNION SELECT start, dst, hop + 1 FROM rc JOIN e ON rc.id = e.src WHERE hop < 2)
    SELECT start, id, min(hop)::BIGINT AS hop FROM rc GROUP BY ALL""",
)
def n3(spark, sf):
    """Two hops around every protected asset."""
    starts = graph_board(spark, sf).where("asset_norad IS NOT NULL").select(G.oid("sat", "asset_norad").alias("id")).distinct()
    found, _ = G.neighbourhood(edges(spark, sf), starts, 2)
    return found.select("start", "id", F.col("hop").cast("bigint").alias("hop"))


@query(
    "n3_traversed_edges",
    f"""WITH RECURSIVE {EDGE_SQL}, e AS (SELECT DISTINCT src, dst FROM ed), s AS (SELECT DISTINCT 'sat:' || asset_norad AS start FROM sb WHERE asset_norad IS NOT NULL),
    rc AS (SELECT start, start AS id, 0 AS hop FROM s UNION SELECT start, dst, hop + 1 FROM rc JOIN e ON rc.id = e.src WHERE hop < 2),
    n AS (SELECT start, id, min(hop) AS hop FROM rc GROUP BY ALL)
    SELECT DISTINCT start, (hop + 1)::BIGINT AS hop, src, dst, type, label, pair_risk FROM n JOIN ed ON n.id = ed.src WHERE hop < 2""",
)
def n3e(spark, sf):
    """The edges walked on the way, with their properties."""
    starts = graph_board(spark, sf).where("asset_norad IS NOT NULL").select(G.oid("sat", "asset_norad").alias("id")).distinct()
    _, walked = G.neighbourhood(edges(spark, sf), starts, 2)
    return walked.select("start", F.col("hop").cast("bigint").alias("hop"), "src", "dst", "type", "label", "pair_risk").distinct()


@query(
    "n4_object_sets",
    f"""WITH {STATUS_SQL} SELECT 'suspects' AS set_id, 'sat:' || norad_id AS id FROM sb WHERE role = 'suspect' UNION ALL SELECT 'assets', 'sat:' || norad_id FROM sb WHERE role = 'asset'
    UNION ALL SELECT 'alerts', 'sat:' || norad_id FROM sb WHERE is_detection OR is_anomaly""",
)
def n4(spark, sf):
    """Set membership in long form, so a set of any size stays distributed."""
    c = F.col
    sets = F.array_compact(
        F.array(
            F.when(c("role") == "suspect", "suspects"), F.when(c("role") == "asset", "assets"), F.when(c("is_detection") | c("is_anomaly"), "alerts")
        )
    )
    return graph_board(spark, sf).select(F.explode(sets).alias("set_id"), G.oid("sat", "norad_id").alias("id"))


@query(
    "n5_provenance",
    f"""WITH {STATUS_SQL}, m AS (SELECT count(*) AS n_windows, count(DISTINCT user_id) AS n_sats, substr(sha256('value|ts'), 1, 16) AS schema_hash FROM events)
    SELECT norad_id, status, n_windows, n_sats, schema_hash FROM sb, m""",
)
def n5(spark, sf):
    """Model provenance on every output row, from a one-row metadata scalar."""
    from driftline.functions.scalars import schema_hash
    from driftline.plans.inputs import events

    meta = events(spark, sf).agg(F.count("*").alias("n_windows"), F.countDistinct("user_id").alias("n_sats")).select(F.struct("n_windows", "n_sats")).scalar()
    return graph_board(spark, sf).withColumn("m", meta).select(
        "norad_id", "status", "m.n_windows", "m.n_sats", schema_hash(F.array(F.lit("value"), F.lit("ts"))).alias("schema_hash")
    )


@query(
    "n6_star_graph",
    f"""WITH {EDGE_SQL}, rk AS (SELECT src, dst, type, row_number() OVER (PARTITION BY src, type ORDER BY dst) AS k FROM ed WHERE src LIKE 'sat:%' AND type IN ('threatens','hasAlert','validatedBy','weather','fusedAs'))
    SELECT src, dst, type FROM rk WHERE k <= CASE type WHEN 'validatedBy' THEN 2 ELSE 1 END""",
)
def n6(spark, sf):
    kinds = F.col("src").startswith("sat:") & F.col("type").isin("threatens", "hasAlert", "validatedBy", "weather", "fusedAs")
    return G.star(edges(spark, sf), kinds, {"validatedBy": 2}).select("src", "dst", "type")
