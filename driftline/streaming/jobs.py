"""Structured Streaming jobs: idempotent append, rolling detectors, alert states, daily change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftline.operators.skew import keep_last
from driftline.session import scratch_path

# Allowed alert-state transitions.
TRANSITIONS = {
    "OPEN": ("ACKNOWLEDGED", "RESOLVED", "SUPPRESSED"),
    "ACKNOWLEDGED": ("RESOLVED", "SUPPRESSED", "OPEN"),
    "RESOLVED": ("OPEN",),
    "SUPPRESSED": ("OPEN",),
}
ACTION_FOR_STATUS = {
    "ACKNOWLEDGED": "AcknowledgeAlert",
    "RESOLVED": "ResolveAlert",
    "SUPPRESSED": "SuppressAlert",
    "OPEN": "OpenCase",
}


def read_files(spark: SparkSession, folder: str, name: str, schema: T.StructType, per_trigger: int = 1000) -> DataFrame:
    """File-source stream of one table's files in a folder."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    )


def drain(writer: DataStreamWriter, spark: SparkSession, label: str, mark: ClosingMark | None = None) -> None:
    """Process everything available and stop; with a ``mark``, close the stream's time and process what waited for that.

    Progress lives in the shared folder.
    """
    progress = scratch_path(spark, f"{label}-progress")
    run = lambda: writer.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    run()
    if mark is not None:
        mark.write()
        run()


class ClosingMark:
    """A row without a key whose only work is to move the watermark: the end of a finished input.

    Its source is an empty folder until :meth:`write`, so the rows before it are all processed first.
    """

    def __init__(self, spark: SparkSession, ts: str, at: str):
        self.spark, self.ts, self.at, self.path = spark, ts, at, scratch_path(spark, "closing-mark")
        self._rows().limit(0).write.parquet(self.path)

    def _rows(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(self.at).cast("timestamp").alias(self.ts))

    def write(self) -> None:
        self._rows().write.mode("append").parquet(self.path)

    def behind(self, stream: DataFrame, delay: str) -> DataFrame:
        """``stream`` with its watermark, which follows the mark, too; the mark itself goes."""
        mark = self.spark.readStream.schema(T.StructType([T.StructField(self.ts, T.TimestampType())])).parquet(self.path)
        both = stream.unionByName(mark, allowMissingColumns=True).withWatermark(self.ts, delay)
        # Asked by time, so that the filter stays behind the watermark.
        return both.where(F.col(self.ts) < F.lit(self.at).cast("timestamp"))


def upsert_days(stream: DataFrame, keys: list[str], ts: str, order: list[str], path: str) -> DataStreamWriter:
    """Keep-last upsert into a history partitioned by day; late rows find their day whatever its age.

    A batch writes whole days, merged with what the days held after earlier batches, into a folder of
    its own. Run again, it reads the same earlier state and overwrites its own folder, so nothing
    changes. ``order`` says which of two rows of a key is later; the batch itself decides first.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumn("day", F.to_date(ts)).withColumn("__new", F.lit(True))
        days = [r[0] for r in new.select("day").distinct().collect()]  # bounded by the calendar
        merged = new
        if held := history(batch.sparkSession, path, batch_id):
            old = held.where(F.col("day").isin(days)).withColumn("__new", F.lit(False))
            merged = new.unionByName(old)
        kept = keep_last(merged, keys, [F.desc("__new"), *[F.desc(c) for c in order]]).drop("__new")
        kept.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(save).outputMode("append")


def history(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Every day of an upserted history as of its last batch (of those below ``before``); None if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root) or not any(f.getPath().getName().startswith("batch=") for f in fs.listStatus(root)):
        return None
    rows = spark.read.option("basePath", path).parquet(path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    # Both are partition columns; a calendar of days decides which folders are read.
    last = rows.groupBy("day").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), ["day", "batch"], "left_semi").drop("batch")


def _window_stats(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative-sum and weighted-average chart values of full windows, one along the last axis."""
    d = np.diff(v)
    base = d[..., :-1]
    med = np.median(base, axis=-1)
    core = 1.4826 * np.median(np.abs(base - med[..., None]), axis=-1)
    core = np.where(core < 1e-12, np.maximum(base.std(axis=-1), 1e-9), core)
    z = (d - med[..., None]) / np.maximum(core, 0.05)[..., None]
    up = down = top = e = top_e = np.zeros(z.shape[:-1])
    for i in range(z.shape[-1]):
        x = z[..., i]
        up, down = np.fmax(0.0, up + x - 0.5), np.fmax(0.0, down - x - 0.5)
        e = 0.2 * x + 0.8 * e
        top, top_e = np.fmax(top, np.fmax(up, down)), np.fmax(top_e, np.abs(e))
    return np.minimum(1.0, top / 4.0), np.minimum(1.0, top_e / (3.0 * np.sqrt(0.2 / 1.8)))


#: Entities are dealt into so many groups. A call costs milliseconds however few its rows, so one call serves a
#: group; its rows are this part of a micro-batch. Like the shuffle partitions, fixed while a stream has state.
GROUPS = 1024
#: Windows that are priced at once.
SLICE = 65_536


def _dealt(key: str) -> list[Column]:
    """The group of an entity, and the entity within it; rows without one are a group of their own, -1."""
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.hash(key), F.lit(GROUPS)))
    return [group.alias("group"), F.coalesce(key, F.lit(0)).alias(key)]


def _named(out: pd.DataFrame, key: tuple, schema: T.StructType) -> Iterator[pd.DataFrame]:
    """A group's result rows, if any; see :func:`_dealt`."""
    if len(out):
        yield (out if key[0] >= 0 else out.assign(user_id=None))[schema.names]


def in_order(pdf: pd.DataFrame | None, held: tuple | None, columns: list[str], mark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows that no later arrival can precede, in order of time, and those that still wait.

    ``held`` are the waiting rows of the state, one list per column; the first two columns are the time
    in microseconds and the tie-breaker. What is at or below the watermark ``mark`` (milliseconds) is
    final, as Spark lets no such row in any more.
    """
    old = pd.DataFrame(dict(zip(columns, held)) if held is not None else {c: [] for c in columns})
    parts = [x[columns] for x in (old, pdf) if x is not None and len(x)]
    both = (pd.concat(parts) if parts else old).sort_values(columns[:2], kind="stable")
    done = both[columns[0]] <= mark * 1000
    return both[done], both[~done]


def _frame(frames: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """One group's rows of one micro-batch; bounded by the trigger's file limit."""
    parts = [x for x in frames if len(x)]
    return pd.concat(parts) if parts else None


def _wait(state: GroupState, waiting: pd.DataFrame, mark: int, more: int | None = None) -> None:
    """Calls the group again once the watermark reaches its first waiting row, or the later moment ``more``."""
    moments = ([int(waiting.iloc[0, 0]) // 1000 + 1] if len(waiting) else []) + ([more] if more is not None else [])
    if moments:
        state.setTimeoutTimestamp(max(min(moments), mark + 1))


ROLLING = T.StructType(
    [T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()),
     T.StructField("cusum", T.DoubleType()), T.StructField("ewma", T.DoubleType())]
)
RING = T.StructType(
    [T.StructField("us", T.ArrayType(T.LongType())), T.StructField("event_id", T.ArrayType(T.LongType())), T.StructField("user_id", T.ArrayType(T.LongType())),
     T.StructField("value", T.ArrayType(T.DoubleType())), T.StructField("ring_of", T.ArrayType(T.LongType())), T.StructField("ring", T.ArrayType(T.DoubleType()))]
)


def rolling_detectors(stream: DataFrame, ts: str, size: int = 20) -> DataFrame:
    """Chart values of the last ``size`` rows of each entity, in order of event time, whatever the order of arrival.

    ``stream`` has its watermark. Rows wait in the state until the watermark passes them and then go
    through their entity's ring of ``size`` values; rows that come behind the watermark are dropped by
    Spark. State is the rings and the rows of one watermark delay. The batch windows are the specification.
    """
    columns = ["us", "event_id", "user_id", "value"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        mark = state.getCurrentWatermarkMs()
        ready, waiting = in_order(_frame(frames), held and held[:4], columns, mark)
        ring_of, ring = held[4:] if held else ([], [])
        # An entity's ring, then its new rows.
        user = np.concatenate([np.array(ring_of, np.int64), ready["user_id"].to_numpy(np.int64)])
        order = np.argsort(user, kind="stable")
        user, v = user[order], np.concatenate([np.array(ring, float), ready["value"].to_numpy(float)])[order]
        at = np.arange(len(user))
        full = (order >= len(ring)) & (at - np.searchsorted(user, user) >= size - 1)
        out = []
        for ends in np.split(at[full], range(SLICE, int(full.sum()), SLICE)):
            if len(ends):
                cusum, ewma = _window_stats(np.lib.stride_tricks.sliding_window_view(v, size)[ends - (size - 1)])
                ids = ready["event_id"].to_numpy(np.int64)[order[ends] - len(ring)]
                out.append(pd.DataFrame({"user_id": user[ends], "event_id": ids, "cusum": cusum, "ewma": ewma}))
        kept = np.searchsorted(user, user, "right") - at < size
        state.update((*(waiting[c].astype(k).tolist() for c, k in zip(columns, ("int64", "int64", "int64", float))), user[kept].tolist(), v[kept].tolist()))
        _wait(state, waiting, mark)
        for part in out:
            yield from _named(part, key, ROLLING)

    rows = stream.select(*_dealt("user_id"), F.unix_micros(ts).alias("us"), "event_id", F.col("value").cast("double").alias("value"), ts)
    return rows.groupBy("group").applyInPandasWithState(step, ROLLING, RING, "append", GroupStateTimeout.EventTimeTimeout)


def transition(prev: Column, want: Column) -> Column:
    """Whether a state change is allowed; staying in a state always is."""
    ok = prev == want
    for a, bs in TRANSITIONS.items():
        ok = ok | ((prev == a) & want.isin(*bs))
    return ok


def lifecycle(log: DataFrame, key: str, order: str, want: str) -> DataFrame:
    """Batch fold of an action log into final state and counts of accepted / rejected changes.

    The outcome of a run of requests depends only on the state it starts in, so each block of
    requests is reduced to a map over the four states and blocks are chained in order. A key with
    any number of requests stays spread over blocks.
    """
    from driftline.operators import skew

    names = list(TRANSITIONS)
    rows = log.withColumn("__blk", F.floor(F.col(order) / skew.BLOCK_ROWS))
    runs = rows.groupBy(key, "__blk").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(want).alias("w")))).alias("r"))

    def fold(start: str) -> Column:
        zero = F.struct(F.lit(start).alias("s"), F.lit(0).cast("bigint").alias("ok"), F.lit(0).cast("bigint").alias("bad"))
        return F.aggregate(
            "r", zero,
            lambda a, x: F.struct(
                F.when(transition(a["s"], x["w"]), x["w"]).otherwise(a["s"]).alias("s"),
                (a["ok"] + transition(a["s"], x["w"]).cast("bigint")).alias("ok"),
                (a["bad"] + (~transition(a["s"], x["w"])).cast("bigint")).alias("bad"),
            ),
        )

    def state(s: Column | str) -> Column:
        s = F.lit(s) if isinstance(s, str) else s
        none = F.lit(0).cast("bigint")
        return F.struct(s.alias("s"), none.alias("ok"), none.alias("bad"))

    number = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i + 1)])

    def link(a, x):
        m = F.element_at(x["m"], F.element_at(number, a["s"]))
        return F.struct(m["s"].alias("s"), (a["ok"] + m["ok"]).alias("ok"), (a["bad"] + m["bad"]).alias("bad"))

    in_order = F.array_sort(F.collect_list(F.struct("__blk", "m"))).alias("b")
    maps = runs.select(key, "__blk", F.array(*[fold(s) for s in names]).alias("m"))
    # Neighbouring blocks are composed once more, so the last chain is short even for a huge key.
    groups = maps.groupBy(key, F.floor(F.col("__blk") / skew.BLOCK_ROWS).alias("__g")).agg(in_order)
    wide = groups.select(key, F.col("__g").alias("__blk"), F.array(*[F.aggregate("b", state(s), link) for s in names]).alias("m"))
    chain = wide.groupBy(key).agg(in_order)
    return chain.select(key, F.aggregate("b", state("OPEN"), link).alias("f")).select(
        key, F.col("f.s").alias("status"), F.col("f.ok").alias("accepted"), F.col("f.bad").alias("rejected")
    )


AUDIT = T.StructType(
    [T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("previous_status", T.StringType()),
     T.StructField("status", T.StringType()), T.StructField("accepted", T.BooleanType()), T.StructField("action", T.StringType())]
)
STATE = T.StructType(
    [T.StructField("us", T.ArrayType(T.LongType())), T.StructField("event_id", T.ArrayType(T.LongType())), T.StructField("user_id", T.ArrayType(T.LongType())),
     T.StructField("want", T.ArrayType(T.StringType())), T.StructField("status_of", T.ArrayType(T.LongType())), T.StructField("status", T.ArrayType(T.StringType()))]
)


def lifecycle_stream(stream: DataFrame, ts: str, want: str) -> DataFrame:
    """Audit log of requested changes in order of their time; the current state per key is kept as stream state.

    ``stream`` has its watermark; requests wait for it, so the order of arrival does not matter.
    """
    columns = ["us", "event_id", "user_id", "want"]
    moves = {(a, b): (a, b, True, ACTION_FOR_STATUS[b]) for a, bs in TRANSITIONS.items() for b in (a, *bs)}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        mark = state.getCurrentWatermarkMs()
        ready, waiting = in_order(_frame(frames), held and held[:4], columns, mark)
        status = dict(zip(*held[4:])) if held else {}
        out = []
        for user, w in zip(ready["user_id"].tolist(), ready["want"].tolist()):
            now = status.get(user, "OPEN")
            move = moves.get((now, w)) or (now, now, False, None)
            status[user] = move[1]
            out.append(move)
        state.update((*(waiting[c].astype("int64").tolist() for c in columns[:3]), waiting["want"].tolist(), list(status), list(status.values())))
        _wait(state, waiting, mark)
        audit = pd.DataFrame(out, columns=AUDIT.names[2:])
        yield from _named(audit.assign(user_id=ready["user_id"].to_numpy(), event_id=ready["event_id"].to_numpy()), key, AUDIT)

    rows = stream.select(*_dealt("user_id"), F.unix_micros(ts).alias("us"), "event_id", F.col(want).alias("want"), ts)
    return rows.groupBy("group").applyInPandasWithState(step, AUDIT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


DAY_US = 86_400_000_000
CHANGE = T.StructType(
    [T.StructField("user_id", T.LongType()), T.StructField("day", T.DateType()), T.StructField("score", T.DoubleType()),
     T.StructField("delta", T.DoubleType()), T.StructField("n", T.LongType())]
)
DAYS = T.StructType(
    [T.StructField("user_id", T.ArrayType(T.LongType())), T.StructField("day", T.ArrayType(T.LongType())), T.StructField("total", T.ArrayType(T.DoubleType())), T.StructField("n", T.ArrayType(T.LongType())),
     T.StructField("last_of", T.ArrayType(T.LongType())), T.StructField("last_day", T.ArrayType(T.LongType())), T.StructField("last_score", T.ArrayType(T.DoubleType()))]
)


def daily_change(stream: DataFrame, ts: str) -> DataFrame:
    """Mean value per entity and closed day, and its change against exactly the day before.

    ``stream`` has its watermark. State is the sums of the days that are still open and the last closed
    day's score; an entity whose last closed day can be no one's yesterday any more is forgotten.
    """
    ends = lambda day, days: (day + days) * DAY_US // 1000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([],) * len(DAYS)
        mark, pdf = state.getCurrentWatermarkMs(), _frame(frames)
        user, day, total, n, of, last_day, last_score = (np.array(x, f) for x, f in zip(held, (np.int64, np.int64, float, np.int64, np.int64, np.int64, float)))
        parts = [pd.DataFrame({"user_id": user, "day": day, "total": total, "n": n})]
        last = pd.DataFrame({"user_id": of, "day": last_day, "score": last_score})
        if pdf is not None:
            pdf = pdf.dropna(subset=["us"])
            new = pd.DataFrame({"user_id": pdf["user_id"], "day": pdf["us"].astype(np.int64) // DAY_US, "total": pdf["value"]})
            parts.append(new.groupby(["user_id", "day"], as_index=False).agg(n=("total", "count"), total=("total", "sum")))
        per = pd.concat(parts).groupby(["user_id", "day"], as_index=False)[["total", "n"]].sum()
        shut = ends(per["day"], 1) <= mark
        closed, open_ = per[shut], per[~shut]
        # A day without any value has no mean.
        closed = closed.assign(score=closed["total"] / closed["n"].where(closed["n"] > 0))
        known = pd.concat([last, closed[["user_id", "day", "score"]]])
        yesterday = known.assign(day=known["day"] + 1).rename(columns={"score": "before"})
        out = closed.merge(yesterday, "left", ["user_id", "day"])
        # Only the newest day can still be a yesterday, and only until the next one is closed.
        last = known[ends(known["day"], 2) > mark]
        if len(open_) or len(last):
            state.update((*(open_[c].tolist() for c in ("user_id", "day", "total", "n")), *(last[c].tolist() for c in ("user_id", "day", "score"))))
            state.setTimeoutTimestamp(max(int(min([*ends(open_["day"], 1), *ends(last["day"], 2)])), mark + 1))
        elif state.exists:
            state.remove()
        out = out.assign(delta=out["score"] - out["before"], day=pd.to_datetime(out["day"], unit="D").dt.date)
        yield from _named(out, key, CHANGE)

    rows = stream.select(*_dealt("user_id"), F.unix_micros(ts).alias("us"), F.col("value").cast("double").alias("value"), ts)
    return rows.groupBy("group").applyInPandasWithState(step, CHANGE, DAYS, "append", GroupStateTimeout.EventTimeTimeout)


#: Hours of silence from which on data count as ageing and as stale, and what that takes off.
AGEING, STALE = (36, 0.15), (72, 0.35)
HOUR_MS = 3_600_000
SEEN = T.StructType(
    [T.StructField("user_id", T.LongType()), T.StructField("us", T.LongType()), T.StructField("penalty", T.DoubleType())]
)
LAST = T.StructType([T.StructField("us", T.LongType()), T.StructField("penalty", T.DoubleType())])


def staleness(stream: DataFrame, ts: str) -> DataFrame:
    """Last time per entity and what its age takes off, told anew whenever either changes.

    ``stream`` has its watermark, which is the clock. A stale entity is told once and forgotten; its
    next row starts it anew.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, told = state.get if state.exists else (None, None)
        mark, pdf = state.getCurrentWatermarkMs(), _frame(frames)
        if pdf is not None and (us is None or pdf["us"].max() > us):
            us, told = int(pdf["us"].max()), None
        age = mark * 1000 - us
        now = next((p for h, p in (STALE, AGEING) if age > h * HOUR_MS * 1000), 0.0)
        out = [(key[0], us, now)] if told is None or now != told else []
        if now == STALE[1]:
            state.remove()
        else:
            state.update((us, now))
            hours = AGEING[0] if now == 0.0 else STALE[0]
            state.setTimeoutTimestamp(max(us // 1000 + hours * HOUR_MS + 1, mark + 1))
        yield pd.DataFrame(out, columns=[f.name for f in SEEN])

    rows = stream.select("user_id", F.unix_micros(ts).alias("us"), ts)
    return rows.groupBy("user_id").applyInPandasWithState(step, SEEN, LAST, "append", GroupStateTimeout.EventTimeTimeout)


def stale_penalty(age_hours: Column) -> Column:
    """Late data lowers reliability instead of being dropped."""
    return F.when(age_hours > STALE[0], STALE[1]).when(age_hours > AGEING[0], AGEING[1]).otherwise(0.0)
