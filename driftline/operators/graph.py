"""Typed object graph as node and edge tables, and neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import scalars as X
from driftline.functions.scalars import slug
from driftline.operators import joins as J
from driftline.operators import skew
from driftline.session import materialize


def oid(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _alerting() -> Column:
    return F.col("is_anomaly") | F.col("is_detection") | (F.col("status") != "NOMINAL")


#: What an edge tells besides its ends and type; a type fills those that it has.
EDGE_PROPERTIES = {"label": "string", "pair_risk": "double", "distance_km": "double", "t_peak": "date", "is_placebo": "boolean"}


def edge(src: Column, dst: Column, kind: str, **properties: Column) -> Column:
    """Struct of one edge with all properties."""
    told = [properties.get(k, F.lit(None)).cast(t).alias(k) for k, t in EDGE_PROPERTIES.items()]
    return F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), *told)


def object_edges(board: DataFrame) -> DataFrame:
    """Links every board row has on its own: threatens, hasAlert, weather, fusedAs and back-links.

    One pass: each row emits its links as an array.
    """
    me, name = oid("sat", "norad_id"), F.col("name")
    alert, weather, evidence = (oid(k, "norad_id") for k in ("alert", "wx", "ev"))
    has_ev = F.col("belief").isNotNull()
    pair = F.concat("risk_level", F.lit(" risk "), X.two_places(F.col("pair_risk").cast("double")))
    links = F.array_compact(
        F.array(
            F.when(
                F.col("asset_norad").isNotNull(),
                edge(me, oid("sat", "asset_norad"), "threatens", label=pair, pair_risk=F.col("pair_risk"), distance_km=F.col("pair_dist")),
            ),
            F.when(_alerting(), edge(me, alert, "hasAlert", label=F.col("status"))),
            F.when(_alerting(), edge(alert, me, "source", label=name)),
            edge(me, weather, "weather", label=F.lit("daily index")),
            edge(weather, me, "windowOf", label=name),
            F.when(has_ev, edge(me, evidence, "fusedAs", label=F.concat(F.lit("Bel "), X.two_places(F.col("belief").cast("double"))))),
            F.when(has_ev, edge(evidence, me, "about", label=name)),
        )
    )
    return board.select(F.inline(links))


def peer_edges(board: DataFrame, k: int = 4) -> DataFrame:
    """sameAsset links between suspects of one asset, threatenedBy links of the asset itself."""
    pairs = board.where("asset_norad IS NOT NULL").select("norad_id", "asset_norad", "pair_risk", "name")
    peers = J.top_peers(pairs, "norad_id", "asset_norad", "pair_risk", k, ["name"])
    same = edge(oid("sat", "norad_id"), oid("sat", "peer"), "sameAsset", label=F.col("peer_name"), pair_risk=F.col("peer_score"))
    top = skew.latest_rows(pairs, ["asset_norad"], [F.desc("pair_risk"), F.asc("norad_id")], k)
    assets = board.where("role = 'asset'").select(F.col("norad_id").alias("asset_norad"))
    by = edge(oid("sat", "asset_norad"), oid("sat", "norad_id"), "threatenedBy", label=F.col("name"), pair_risk=F.col("pair_risk"))
    return peers.select(same.alias("e")).unionByName(top.join(assets, "asset_norad").select(by.alias("e"))).select("e.*")


def case_edges(cases: DataFrame, k: int = 3) -> DataFrame:
    """validatedBy links to an object's cases and samePeak links to placebo cases of its peak days."""
    own = skew.latest_rows(cases, ["norad_id"], [F.asc("t_peak"), F.asc("id")], k)
    placebo = F.col("type").startswith("placebo")
    valid = edge(oid("sat", "norad_id"), oid("case", "id"), "validatedBy", label=F.col("id"), t_peak=F.col("t_peak"), is_placebo=placebo)
    same = edge(oid("sat", "norad_id"), oid("case", "placebo_id"), "samePeak", label=F.col("placebo_id"), t_peak=F.col("t_peak"), is_placebo=F.lit(True))
    peaks = cases.select("id", "norad_id", "t_peak").distinct()
    return own.select(valid.alias("e")).unionByName(J.same_peak(cases, k).join(peaks, ["id", "norad_id"]).select(same.alias("e"))).select("e.*")


def document_edges(cases: DataFrame) -> DataFrame:
    """mentions and validatedBy links from source documents to cases."""
    d = cases.select("id", F.explode("sources").alias("source")).select(
        F.concat(F.lit("doc:"), slug(F.col("source"))).alias("src"), oid("case", "id").alias("dst")
    )
    return d.distinct().select("src", "dst", F.explode(F.array(F.lit("mentions"), F.lit("validatedBy"))).alias("type"))


def nodes(board: DataFrame, cases: DataFrame) -> DataFrame:
    """All typed nodes with role, status and score where they have them; documents appear once however many cases cite them."""
    none = F.lit(None)

    def node(i: Column, kind: str, label: Column, role: Column = none, status: Column = none, score: Column = none) -> Column:
        return F.struct(i.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), role.cast("string").alias("role"), status.cast("string").alias("status"), score.cast("double").alias("score"))

    c = F.col
    own = board.select(
        F.inline(
            F.array_compact(
                F.array(
                    node(oid("sat", "norad_id"), "satellite", c("name"), c("role"), c("status"), c("score")),
                    F.when(_alerting(), node(oid("alert", "norad_id"), "alert", c("status"), c("role"), c("status"), c("attention"))),
                    F.when(c("belief").isNotNull(), node(oid("ev", "norad_id"), "evidence", F.lit("belief"), score=c("belief"))),
                    node(oid("wx", "norad_id"), "weather", F.lit("daily index")),
                )
            )
        )
    )
    case = cases.dropDuplicates(["id"]).select(node(oid("case", "id"), "case", c("id"), status=c("type")).alias("n")).select("n.*")
    docs = cases.select(F.explode("sources").alias("source")).groupBy(F.concat(F.lit("doc:"), slug(c("source"))).alias("i")).agg(F.min("source").alias("source"))
    return own.unionByName(case).unionByName(docs.select(node(c("i"), "document", c("source")).alias("n")).select("n.*"))


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes within 1..3 hops of each start (``start, id, hop``) and the edges walked (``start, hop`` and the edge).

    Breadth first for all starts at once: each hop joins only the new frontier and drops what the
    start has seen. Edges are written once, and so is every hop, so no hop is computed again by the next.
    """
    hops = max(1, min(int(hops), 3))
    e = materialize(edges, "graph-edges")
    frontier = materialize(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hop")), "graph-starts")
    seen, walked = [frontier], []
    for h in range(1, hops + 1):
        step = frontier.select("start", F.col("id").alias("src")).join(e, "src").withColumn("hop", F.lit(h))
        walked.append(materialize(step, "graph-walked"))
        known = union_all([s.select("start", "id") for s in seen])
        new = walked[-1].select("start", F.col("dst").alias("id")).distinct().join(known, ["start", "id"], "left_anti")
        frontier = materialize(new.withColumn("hop", F.lit(h)), "graph-frontier")
        seen.append(frontier)
    return union_all(seen), union_all(walked).distinct()


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def star(edges: DataFrame, center: Column, caps: dict[str, int]) -> DataFrame:
    """Links of each centre with at most ``caps`` of a type (the object card)."""
    own = edges.where(center)
    cap = reduce(lambda acc, kv: acc.when(F.col("type") == kv[0], kv[1]), caps.items(), F.when(F.lit(False), 0)).otherwise(1)
    w = Window.partitionBy("src", "type").orderBy("dst")
    return own.withColumn("__r", F.row_number().over(w)).where((F.col("__r") <= max(*caps.values(), 1)) & (F.col("__r") <= cap)).drop("__r")
