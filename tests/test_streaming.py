"""Streaming jobs on input that is split, out of order, late or replayed, against the batch result."""

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import windows as W
from driftline.streaming import jobs

START = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, ts timestamp, value double, want string"
STATES = list(jobs.TRANSITIONS)


def made(users=3, rows=60, seed=1):
    rng = random.Random(seed)
    out = []
    for u in range(users):
        t = START
        for i in range(rows):
            t += dt.timedelta(minutes=rng.choice([0, 30, 60, 90]))
            out.append((u, u * 1000 + i, t, rng.gauss(0, 1) + 5 * (i > 40), rng.choice(STATES)))
    return out


class Folder:
    """A folder of files that arrive one after the other, one a micro-batch."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0

    def add(self, rows):
        self.n += 1
        table = self.spark.createDataFrame(rows, SCHEMA).toPandas()
        table["ts"] = table["ts"].astype("datetime64[us]")
        table.to_parquet(f"{self.path}/part-{self.n}.parquet", index=False)
        time.sleep(0.02)  # files are taken in order of their times

    def stream(self):
        s = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)
        return s.withColumn("ts", F.col("ts").cast("timestamp"))


def three_batches(rows, folder, hours=6, seed=2):
    """Rows up to ``hours`` out of order, in three files of mixed times."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[2] + dt.timedelta(hours=rng.uniform(0, hours)))
    third = len(rows) // 3
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :]):
        rng.shuffle(part)
        folder.add(part)


def run(spark, folder, build, out, delay="8 hours", schema=None, end="2030-01-01"):
    mark = jobs.ClosingMark(spark, "ts", end)
    writer = build(mark.behind(folder.stream(), delay)).writeStream.format("parquet").option("path", out).outputMode("append")
    jobs.drain(writer, spark, "test", mark)
    return spark.read.schema(schema).parquet(out).collect()


def test_rolling_detectors_over_three_unordered_batches(spark, tmp_path):
    rows = made()
    (tmp_path / "in").mkdir()
    folder = Folder(spark, tmp_path / "in")
    three_batches(rows, folder)
    got = run(spark, folder, lambda s: jobs.rolling_detectors(s, "ts"), str(tmp_path / "out"), schema=jobs.ROLLING)
    want = {}
    for u in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1]))
        v = np.array([r[3] for r in mine])
        for i in range(19, len(v)):
            want[mine[i][1]] = jobs._window_stats(v[i - 19 : i + 1])
    assert len(got) == len(want)
    for r in got:
        assert (r["cusum"], r["ewma"]) == pytest.approx(want[r["event_id"]])


def test_rows_behind_the_watermark_stay_out(spark, tmp_path):
    rows = [(1, i, START + dt.timedelta(hours=i), float(i % 5), "OPEN") for i in range(60)]
    late = (1, 999, START + dt.timedelta(hours=2), 1e6, "SUPPRESSED")
    (tmp_path / "in").mkdir()
    folder = Folder(spark, tmp_path / "in")
    for part in (rows[:30], rows[30:45], [late, *rows[45:]]):
        folder.add(part)
    got = run(spark, folder, lambda s: jobs.rolling_detectors(s, "ts"), str(tmp_path / "out"), "2 hours", jobs.ROLLING)
    v = np.array([r[3] for r in rows])
    assert {r["event_id"]: r["cusum"] for r in got} == pytest.approx({i: jobs._window_stats(v[i - 19 : i + 1])[0] for i in range(19, 60)})


def test_lifecycle_over_three_unordered_batches(spark, tmp_path):
    rows = made(seed=4)
    (tmp_path / "in").mkdir()
    folder = Folder(spark, tmp_path / "in")
    three_batches(rows, folder)
    got = run(spark, folder, lambda s: jobs.lifecycle_stream(s, "ts", "want"), str(tmp_path / "out"), schema=jobs.AUDIT)
    log = W.numbered(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", ["event_id"])
    batch = {r["user_id"]: (r["accepted"], r["rejected"]) for r in jobs.lifecycle(log, "user_id", "pos", "want").collect()}
    assert {u: (sum(r["accepted"] for r in got if r["user_id"] == u), sum(not r["accepted"] for r in got if r["user_id"] == u)) for u in batch} == batch
    audit = {r["event_id"]: (r["previous_status"], r["status"]) for r in got}
    for u in batch:
        now = "OPEN"
        for r in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1])):
            after = r[4] if r[4] == now or r[4] in jobs.TRANSITIONS[now] else now
            assert audit[r[1]] == (now, after)
            now = after


def test_daily_change_keeps_yesterday_in_a_bounded_state(spark, tmp_path):
    rows = [(u, 100 * u + i, START + dt.timedelta(hours=5 * i), float(i), "OPEN") for u in (1, 2) for i in range(30)]
    rows += [(3, 900, START, 7.0, "OPEN"), (3, 901, START + dt.timedelta(days=3), 9.0, "OPEN")]
    (tmp_path / "in").mkdir()
    folder = Folder(spark, tmp_path / "in")
    three_batches(rows, folder)
    mark = jobs.ClosingMark(spark, "ts", "2024-03-01")
    out = str(tmp_path / "out")
    writer = jobs.daily_change(mark.behind(folder.stream(), "8 hours"), "ts").writeStream.format("parquet").option("path", out).outputMode("append")
    progress = []
    for closed in (False, True):
        if closed:
            mark.write()
        q = writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        q.awaitTermination()
        progress.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    table = pd.DataFrame(rows, columns=SCHEMA.replace(",", "").split()[::2])
    table["day"] = table["ts"].dt.date
    want = {}
    for (u, d), v in table.groupby(["user_id", "day"])["value"].mean().items():
        want[u, d] = v
    got = {(r["user_id"], r["day"]): (r["score"], r["delta"]) for r in spark.read.schema(jobs.CHANGE).parquet(out).collect()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want)
    for (u, d), (s, delta) in got.items():
        y = want.get((u, d - dt.timedelta(days=1)))
        assert delta == (pytest.approx(s - y) if y is not None else None)
    assert progress == [2, 0]  # the third entity was forgotten already, and all once time has passed


def test_staleness_follows_the_watermark_and_forgets(spark, tmp_path):
    hour = lambda h: START + dt.timedelta(hours=h)
    (tmp_path / "in").mkdir()
    folder = Folder(spark, tmp_path / "in")
    folder.add([(1, 1, hour(0), 0.0, ""), (2, 2, hour(30), 0.0, ""), (4, 7, hour(1), 0.0, "")])
    folder.add([(3, 3, hour(50), 0.0, ""), (2, 4, hour(20), 0.0, "")])  # older news of 2 change nothing
    folder.add([(3, 5, hour(90), 0.0, "")])
    folder.add([(4, 6, hour(110), 0.0, "")])
    got = run(spark, folder, lambda s: jobs.staleness(s, "ts"), str(tmp_path / "out"), "12 hours", jobs.SEEN, "2024-01-05 18:00:00")  # hour 114, clock 102
    told = {}
    for r in got:
        told.setdefault((r["user_id"], r["us"] // 3_600_000_000 - int(pd.Timestamp(START).value // 3_600_000_000_000)), []).append(r["penalty"])
    last = {u: max((h, max(p)) for (v, h), p in told.items() if v == u) for u in (1, 2, 3, 4)}
    assert last == {1: (0, 0.35), 2: (30, 0.15), 3: (90, 0.0), 4: (110, 0.0)}
    assert sorted(told[1, 0]) == [0.0, 0.15, 0.35] and max(told[4, 1]) >= 0.15


def test_upsert_keeps_last_and_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "history")
    mk = lambda rows: spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, value double")
    saves = []

    class Writer:
        def foreachBatch(self, f):  # noqa: N802
            saves.append(f)
            return self

        def outputMode(self, _):  # noqa: N802
            return self

    class Stream:
        writeStream = Writer()

    jobs.upsert_days(Stream(), ["user_id", "ts"], "ts", ["event_id"], path)
    save, day = saves[0], lambda d: dt.datetime(2024, 1, d)
    assert jobs.history(spark, path) is None
    batches = [
        mk([(1, day(1), 1, 1.0), (1, day(1), 2, 2.0), (1, day(2), 3, 3.0)]),
        mk([(1, day(2), 1, 30.0), (2, day(5), 4, 4.0)]),  # an older event id in a later batch is news
        mk([(1, day(1), 9, 10.0)]),  # late
    ]
    rows = lambda: sorted((r["user_id"], r["ts"].day, r["value"]) for r in jobs.history(spark, path).collect())
    for i, b in enumerate(batches):
        save(b, i)
    want = [(1, 1, 10.0), (1, 2, 30.0), (2, 5, 4.0)]
    assert rows() == want
    for i in (2, 1, 2):
        save(batches[i], i)
        assert rows() == want
    assert "day" in jobs.history(spark, path).columns and "batch" not in jobs.history(spark, path).columns


def test_window_statistics_of_many_windows_are_those_of_each():
    """Windows were priced one call each, in a loop over their values."""
    def plain(v):
        d = np.diff(v)
        base = d[:-1]
        med = np.median(base)
        core = 1.4826 * np.median(np.abs(base - med))
        z = (d - med) / max(core if core >= 1e-12 else max(base.std(), 1e-9), 0.05)
        up = down = top = e = top_e = 0.0
        for x in z:
            up, down, e = max(0.0, up + x - 0.5), max(0.0, down - x - 0.5), 0.2 * x + 0.8 * e
            top, top_e = max(top, up, down), max(top_e, abs(e))
        return min(1.0, top / 4.0), min(1.0, top_e / (3.0 * np.sqrt(0.2 / 1.8)))

    rng = np.random.default_rng(3)
    w = np.concatenate([rng.normal(size=(50, 20)), np.ones((1, 20)), np.eye(20) * 0.1, np.full((1, 20), np.nan)])
    cusum, ewma = jobs._window_stats(w)
    assert list(zip(cusum, ewma)) == [pytest.approx(plain(v)) for v in w]


def test_entities_share_calls_and_rows_without_one_stay_apart(spark, tmp_path, monkeypatch):
    """Every entity was a call of its own, of milliseconds whatever its rows."""
    monkeypatch.setattr(jobs, "GROUPS", 2)
    monkeypatch.setattr(jobs, "SLICE", 7)
    rows = made(users=9, rows=30, seed=8)
    rows += [(None, 50_000 + i, START + dt.timedelta(hours=i), float(i % 7), "OPEN") for i in range(25)]
    (tmp_path / "in").mkdir()

    class Whole(Folder):
        def add(self, rows):
            self.n += 1
            table = pd.DataFrame(rows, columns=SCHEMA.replace(",", "").split()[::2])
            table["user_id"] = table["user_id"].astype("Int64")  # whole numbers beside nulls
            table["ts"] = table["ts"].astype("datetime64[us]")
            table.to_parquet(f"{self.path}/part-{self.n}.parquet", index=False)
            time.sleep(0.02)

    folder = Whole(spark, tmp_path / "in")
    three_batches(rows, folder)
    mark = jobs.ClosingMark(spark, "ts", "2030-01-01")
    out = str(tmp_path / "out")
    writer = jobs.rolling_detectors(mark.behind(folder.stream(), "8 hours"), "ts").writeStream.format("parquet").option("path", out).outputMode("append")
    q = writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 3
    mark.write()
    writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    got = {r["event_id"]: (r["user_id"], r["cusum"], r["ewma"]) for r in spark.read.schema(jobs.ROLLING).parquet(out).collect()}
    want = {}
    for u in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1]))
        for i in range(19, len(mine)):
            want[mine[i][1]] = (u, *jobs._window_stats(np.array([r[3] for r in mine[i - 19 : i + 1]])))
    assert got.keys() == want.keys()
    for k, (u, *x) in want.items():
        assert got[k][0] == u and got[k][1:] == pytest.approx(tuple(x))


def test_states_and_days_of_entities_that_share_a_call(spark, tmp_path, monkeypatch):
    """Alert states and daily means, too, were a call for every entity."""
    monkeypatch.setattr(jobs, "GROUPS", 2)
    rows = made(users=9, rows=60, seed=9)
    (tmp_path / "in").mkdir()
    folder = Folder(spark, tmp_path / "in")
    three_batches(rows, folder)
    calls = {}
    for name, build in (("audit", lambda s: jobs.lifecycle_stream(s, "ts", "want")), ("days", lambda s: jobs.daily_change(s, "ts"))):
        mark = jobs.ClosingMark(spark, "ts", "2030-01-01")
        writer = build(mark.behind(folder.stream(), "8 hours")).writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode("append")
        for closed in (False, True):
            if closed:
                mark.write()
            q = writer.option("checkpointLocation", str(tmp_path / f"{name}-progress")).trigger(availableNow=True).start()
            q.awaitTermination()
            calls[name, closed] = q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert calls == {("audit", False): 2, ("audit", True): 2, ("days", False): 2, ("days", True): 0}
    audit = {r["event_id"]: tuple(r) for r in spark.read.schema(jobs.AUDIT).parquet(str(tmp_path / "audit")).collect()}
    days = {(r["user_id"], r["day"]): (r["score"], r["delta"], r["n"]) for r in spark.read.schema(jobs.CHANGE).parquet(str(tmp_path / "days")).collect()}
    assert len(audit) == len(rows)
    for u in range(9):
        now, mine = "OPEN", sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1]))
        for r in mine:
            ok = r[4] == now or r[4] in jobs.TRANSITIONS[now]
            assert audit[r[1]] == (u, r[1], now, r[4] if ok else now, ok, jobs.ACTION_FOR_STATUS[r[4]] if ok else None)
            now = r[4] if ok else now
        table = pd.DataFrame({"day": [r[2].date() for r in mine], "v": [r[3] for r in mine]}).groupby("day")["v"].agg(["mean", "count"])
        assert {d for v, d in days if v == u} == set(table.index)
        for d, (mean, n) in table.iterrows():
            before = table["mean"].get(d - dt.timedelta(days=1))
            assert days[u, d] == (pytest.approx(mean), None if before is None else pytest.approx(mean - before), n)
