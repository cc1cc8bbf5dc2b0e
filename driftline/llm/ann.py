"""Largest inner products by beam search in the robust-pruned graphs of all shards."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.graph_index import BATCH, beam_search, build
from driftline.session import materialize

SHARD_ROWS, QUERY_ROWS, BEAM, SALTS = 16_384, 16_384, 96, 16


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, every component present and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _least_ids(rows: DataFrame, k: int) -> DataFrame:
    """Every distinct ``v`` with its ``k`` smallest ids, counted in two steps so that a common vector is no one task's."""
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    few = rows.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k)
    return few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("ids"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """One more component that gives every vector the norm ``most``; inner products with a query that has 0 there stay."""
    spare = np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0.0))
    return np.concatenate([x, spare[:, None]], axis=1).astype(np.float32) / np.float32(most)


GRAPH = "shard long, n long, vectors binary, edges binary, starts binary, ids array<array<long>>"


def index(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The graph of every shard of the distinct vectors (``v``, ``ids``), and the number of shards.

    Shards are dealt by the vector's hash. A shard's graph is one row of some ten megabytes.
    """
    n, most = distinct.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    shards = max(1, -(-n // shard_rows))
    most = math.sqrt(most or 1.0)

    def graph(key: tuple, table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v"))
        edges, starts = build(_lifted(x, most))
        row = {"shard": [key[0].as_py()], "n": [len(x)], "vectors": [x.tobytes()], "edges": [edges.astype(np.int32).tobytes()], "starts": [starts.astype(np.int64).tobytes()]}
        ids = pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64())))
        return pa.table({**{k: pa.array(v) for k, v in row.items()}, "ids": ids})

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))
    return materialize(dealt.groupBy("shard").applyInArrow(graph, GRAPH), "ann-graph"), shards


def search(graphs: DataFrame, shards: int, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """Per distinct query ``v`` its ``k`` nearest ids over all shards, as ``found`` (score, id), nearest first.

    Queries go to the shards in blocks of ``QUERY_ROWS``, every block to every shard.
    """
    count = queries.count()
    parts = max(1, -(-count // QUERY_ROWS))

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        q, keys, scores, ids = _matrix(left.column("v")), [], [], []
        if right.num_rows:
            r = right.to_pylist()[0]
            x = np.frombuffer(r["vectors"], np.float64).reshape(r["n"], -1)
            edges, starts = np.frombuffer(r["edges"], np.int32).reshape(r["n"], -1).astype(np.int64), np.frombuffer(r["starts"], np.int64)
            most = float(np.sqrt((x * x).sum(axis=1).max()))
            lifted, zero = _lifted(x, most), np.zeros((BATCH, 1), np.float32)
            names = left.column("q").to_pylist()
            for a in range(0, len(q), BATCH):
                some = q[a : a + BATCH]
                flat = np.concatenate([some.astype(np.float32), zero[: len(some)]], axis=1)
                found, sims = beam_search(lifted, edges, starts, flat, min(beam, r["n"]))
                order = np.argsort(-sims, axis=1, kind="stable")[:, : k + 8]
                found = np.take_along_axis(found, order, axis=1)
                for i in range(len(some)):
                    near = found[i][found[i] >= 0]
                    exact = [float(s) for s in (x[near] * some[i]).sum(axis=1)]
                    pairs = sorted((-s, d) for s, n in zip(exact, near.tolist()) for d in r["ids"][n])[:k]
                    keys += [names[a + i]] * len(pairs)
                    scores += [-s for s, _ in pairs]
                    ids += [d for _, d in pairs]
        return pa.table({"q": pa.array(keys, pa.int64()), "score": pa.array(scores, pa.float64()), "id": pa.array(ids, pa.int64())})

    asked = queries.withColumn("part", F.pmod(F.col("q"), F.lit(parts)))
    everywhere = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    carried = graphs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    found = everywhere.groupBy("shard", "part").cogroup(carried.groupBy("shard", "part")).applyInArrow(look, "q long, score double, id long")
    # k rows per query and shard; the best of a query are k again.
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    return top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("found"))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found for every row that ``queries`` holds for.

    Nearness is the inner product in double precision; ties go to the smaller id; a row is no
    candidate of its own. Vectors that aren't :func:`usable`, and rows without an id, take no part.
    Equal vectors are one node of a graph and come out as the rows they are; rows of one id count
    once per vector. Vectors meet those of their own length only. An empty table gives no rows; other
    columns are ignored. All shards are searched; what a beam misses is missed.
    """
    v = F.col(f"`{vector_column}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    out = None
    # A table has one length of vectors, or a few.
    for (size,) in rows.select(F.size("v")).distinct().collect() or [(0,)]:
        mine = rows.where(F.size("v") == size)
        distinct = materialize(_least_ids(mine, k + 1), "ann-vectors")
        graphs, shards = index(distinct, shard_rows)
        # A query's number is the place of its vector in the written table.
        asked = mine.where("asked").select("id", "v")
        numbered = materialize(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "ann-queries")
        found = search(graphs, shards, numbered, k + 1, beam)
        named = asked.join(numbered, "v").join(found, "q")
        others = F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, k)
        part = named.select(F.col("id").alias("query_id"), F.posexplode(others).alias("r", "f"))
        part = part.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.minus")).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
