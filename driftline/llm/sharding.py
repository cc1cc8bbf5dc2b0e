"""Extendible hashing: shards are prefixes of hash bits, split on another bit only when too large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import materialize

#: Bits looked at in one round, and bits of the key's hash; after them the row's own bits are used.
ROUND, KEY_BITS = 12, 60


def key_bits(key: Column) -> Column:
    """The first 60 bits of the key's md5 as a number; a null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _bits(depth: int) -> Column:
    """Bits ``depth - ROUND`` to ``depth`` as a number."""
    if depth <= KEY_BITS:
        return F.shiftright(F.col("key_bits"), KEY_BITS - depth).bitwiseAND((1 << ROUND) - 1)
    return F.shiftright(F.col("row_bits"), 2 * KEY_BITS - depth).bitwiseAND((1 << ROUND) - 1)


def assign(docs: DataFrame, limit_bytes: int, id_column: str = "doc_id", text_column: str = "text", carry: bool = False) -> DataFrame:
    """Row per row of ``docs``: id, ``n_bytes``, ``shard`` (its bits as text) and ``depth``.

    A shard holds at most ``limit_bytes`` of text, unless it is one single row. Rows are placed by
    their id; rows of one id, which no bit of it can part, are parted by further bits of their own.
    Null texts have 0 bytes; a null id counts as the empty text; an empty table gives no rows; other
    columns are left out, or with ``carry`` kept in the struct ``row``. The rows are written to the
    shared folder once, so that their own bits stay as they are.
    """
    own = F.xxhash64(F.monotonically_increasing_id())
    rows = docs.select(
        F.col(id_column).alias(id_column), F.coalesce(F.octet_length(F.col(text_column).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        key_bits(F.col(id_column)).alias("key_bits"), F.shiftrightunsigned(own, 64 - KEY_BITS).alias("row_bits"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []),
    )
    left = materialize(rows, "shard-rows").withColumn("shard", F.lit(""))
    done, depth = [], 0
    while True:
        depth += ROUND
        place = left.withColumn("part", _bits(depth))
        # Sums of bytes per bucket of this round: counted on the way in, so a hot key costs a row per task.
        sums = place.groupBy("shard", "part").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        sums = materialize(sums, "shard-sums")
        up = sums.withColumn("d", F.explode(F.sequence(F.lit(0 if depth == ROUND else 1), F.lit(ROUND)))).withColumn("q", F.expr(f"shiftright(part, {ROUND} - d)"))
        fits = up.groupBy("shard", "d", "q").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        fits = fits.where((F.col("bytes") <= limit_bytes) | (F.col("n") == 1)).select("shard", "d", "q")
        found = up.select("shard", "part", "d", "q").join(fits, ["shard", "d", "q"]).groupBy("shard", "part").agg(F.min("d").alias("d"))
        directory = materialize(sums.select("shard", "part").join(found, ["shard", "part"], "left"), "shard-directory")
        small = depth == ROUND  # at most 4096 rows in the first round
        placed = place.join(F.broadcast(directory) if small else directory, ["shard", "part"])
        bits = F.lpad(F.conv(F.col("part").cast("string"), 10, 2), ROUND, "0")
        placed = placed.withColumn("shard", F.concat("shard", F.substring(bits, F.lit(1), F.coalesce("d", F.lit(ROUND)))))
        done.append(placed.where("d is not null").withColumn("depth", F.lit(depth - ROUND) + F.col("d")))
        if depth >= 2 * KEY_BITS or directory.where("d is null").isEmpty():
            break
        left = materialize(placed.where("d is null").drop("part", "d"), "shard-rows")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(id_column, "n_bytes", "shard", "depth", *(["row"] if carry else []))


def write(docs: DataFrame, path: str, limit_bytes: int, **names) -> None:
    """Writes ``docs`` with a folder per shard; a shard is written by one task."""
    out = assign(docs, limit_bytes, carry=True, **names)
    out.select("row.*", F.concat(F.lit("b"), "shard").alias("__shard")).repartition("__shard").write.partitionBy("__shard").parquet(path)
