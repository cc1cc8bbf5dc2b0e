"""Product codes of vectors, on an integer grid, by k-means with norm-of-sum bounds.

Every part position has a codebook. A part keeps the distance to its own entry and to the nearest
other entry, each with the round it was measured in. As all past codebooks are kept, a later round
moves either bound by the length of an entry's net displacement since that round, which is never
more than the lengths of the single moves added up. Only parts whose bounds cross are measured again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.joins import sized
from driftline.llm.tables import drop, totals, write

PARTS, ENTRIES, ROUNDS, GRID = 16, 64, 2, 256
#: Components beyond it could overflow 64-bit squared distances.
LARGEST = 2.0**18
STATE = "vec_id long, label long, grid binary, codes binary, own binary, other binary, own_round binary, other_round binary"
FIELDS = [f.split()[0] for f in STATE.split(", ")]


class State(NamedTuple):
    """Per row and part: the entry, its distance, that of the nearest other entry, and their rounds."""

    codes: np.ndarray
    own: np.ndarray
    other: np.ndarray
    own_round: np.ndarray
    other_round: np.ndarray


def usable(vector: Column, parts: int = PARTS) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST)
    return F.coalesce(~F.exists(vector, bad) & (F.size(vector) > 0) & (F.size(vector) % parts == 0), F.lit(False))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of grid rows to all entries."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) < 2**23:  # exact in doubles
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def _root(squared: np.ndarray, up: bool) -> np.ndarray:
    """Square root as a float that is surely not below (``up``) or not above the true one."""
    return np.nextafter(np.sqrt(squared.astype(np.float64)).astype(np.float32), np.float32(np.inf if up else -np.inf))


def moved(history: list[np.ndarray], part: int) -> tuple[np.ndarray, np.ndarray]:
    """Net displacement of a part's entries from each kept round to the last: of every entry, and the
    largest of all entries but that one; a row per round."""
    now = history[-1][part]
    net = np.stack([np.sqrt(((now - then[part]) ** 2).sum(axis=1).astype(np.float64)) for then in history])
    if net.shape[1] == 1:
        return net, np.zeros_like(net)
    order = np.argsort(net, axis=1)
    top, second = (np.take_along_axis(net, order[:, k : k + 1], axis=1) for k in (net.shape[1] - 1, net.shape[1] - 2))
    rest = np.broadcast_to(top, net.shape).copy()
    np.put_along_axis(rest, order[:, -1:], second, axis=1)
    return net, rest


def assign(grid: np.ndarray, history: list[np.ndarray], state: State | None) -> tuple[State, np.ndarray]:
    """State against the last codebooks, and how many parts of each row were measured against all entries.

    ``grid`` is rows x parts x width. Ties go to the lower index: bounds must be strictly apart to
    spare a part.
    """
    now, rows, parts = len(history) - 1, grid.shape[0], grid.shape[1]
    new = state if state is not None else State(*(np.zeros((rows, parts), t) for t in (np.uint8, np.float32, np.float32, np.uint8, np.uint8)))
    new = State(*(v.copy() for v in new))
    scans = np.zeros(rows, np.int64)
    for p in range(parts):
        entries, left = history[-1][p], np.arange(rows)
        if state is not None:
            code = new.codes[:, p]
            net, rest = moved(history, p)
            low = (new.other[:, p].astype(np.float64) - rest[new.other_round[:, p], code]) * (1 - 1e-9) - 1e-9
            high = (new.own[:, p].astype(np.float64) + net[new.own_round[:, p], code]) * (1 + 1e-9) + 1e-9
            left = np.flatnonzero(high >= low)
            exact = _root(((grid[left, p] - entries[code[left]]) ** 2).sum(axis=1), True)
            new.own[left, p], new.own_round[left, p] = exact, now
            left = left[exact >= low[left]]
        if not len(left):
            continue
        d = distances(grid[left, p], entries)
        best = d.argmin(axis=1)
        least = d[np.arange(len(left)), best]
        d[np.arange(len(left)), best] = np.iinfo(np.int64).max
        new.codes[left, p], new.own[left, p], new.other[left, p] = best, _root(least, True), _root(d.min(axis=1), False)
        new.own_round[left, p] = new.other_round[left, p] = now
        scans[left] += 1
    return new, scans


def _arrays(block: pa.RecordBatch, width: int, parts: int) -> tuple[np.ndarray, State | None]:
    def read(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(v.as_py() for v in block.column(name)), kind).reshape(block.num_rows, parts)

    grid = np.frombuffer(b"".join(v.as_py() for v in block.column("grid")), np.int32).astype(np.int64).reshape(-1, parts, width)
    return grid, State(*(read(n, k) for n, k in zip(FIELDS[3:], (np.uint8, np.float32, np.float32, np.uint8, np.uint8))))


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(values)], pa.binary())


def _with_state(block: pa.RecordBatch, grid: pa.Array, state: State) -> pa.RecordBatch:
    return pa.record_batch([block.column("vec_id"), block.column("label"), grid, *map(_packed, state)], names=FIELDS)


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows ``vec_id``, ``label``, ``codes`` (a byte a part) and ``error``, and the codebooks of all rounds.

    Components become floor(256 x). Codebooks start with the parts of the ``entries`` smallest ids
    (fewer rows give fewer entries; ties of ids go by vector; null ids come last), and are replaced
    ``rounds`` times by the floored means of their parts. Vectors that are null, empty or hold null
    or non-finite components are left out, and so are vectors whose length differs from that of the
    smallest id's or is no multiple of ``parts``, and components beyond 2^18, whose squares a long
    might not hold. Repeated rows count each; other columns are ignored; an empty table gives no
    rows. The state is one table in the shared folder; that of the round before is deleted once the
    next is written.
    """
    if entries > 256:
        raise ValueError("a code is one byte")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("v")).where(usable(F.col("v"), parts))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    first = [r["v"] for r in first if len(r["v"]) == len(first[0]["v"])]
    if not first:
        none = spark.createDataFrame([], "vec_id long, label long, codes binary, error long")
        return none, [np.zeros((parts, 0, 0), np.int64)]
    size = len(first[0])
    width = size // parts
    rows = rows.where(F.size("v") == size)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    book = np.floor(np.array([r["v"] for r in start], np.float64) * GRID).astype(np.int64)
    history = [book.reshape(-1, parts, width).transpose(1, 0, 2)]
    n = len(start)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            grid = np.floor(flat * GRID).astype(np.int64).reshape(-1, parts, width)
            yield _with_state(batch, _packed(grid.astype(np.int32).reshape(len(grid), -1)), assign(grid, history[:1], None)[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """Components of the parts of every entry, and their number, as one flat array."""
        out = np.zeros((parts, n, width + 1), np.int64)
        for batch in batches:
            grid, state = _arrays(batch, width, parts)
            for p in range(parts):
                np.add.at(out[p], state.codes[:, p], np.concatenate([grid[:, p], np.ones((len(grid), 1), np.int64)], axis=1))
        return out.ravel()

    def step(books: list[np.ndarray]):
        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grid, state = _arrays(batch, width, parts)
                yield _with_state(batch, batch.column("grid"), assign(grid, books, state)[0])

        return again

    state, path = write(rows.mapInArrow(begin, STATE), "codes")
    for r in range(1, rounds + 1):
        got = totals(state, sums, parts * n * (width + 1), np.int64).reshape(parts, n, width + 1)
        count = got[:, :, -1:]
        history.append(np.where(count > 0, got[:, :, :-1] // np.maximum(count, 1), history[-1]))
        if r < rounds:
            before = path
            state, path = write(state.mapInArrow(step(list(history)), STATE), "codes")
            drop(spark, before)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(parts)[None, :]
        for batch in batches:
            grid, state = _arrays(batch, width, parts)
            codes = assign(grid, history, state)[0].codes if rounds else state.codes
            error = ((grid - history[-1][place, codes]) ** 2).sum(axis=(1, 2))
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), _packed(codes), pa.array(error)], names=["vec_id", "label", "codes", "error"])

    return state.mapInArrow(finish, "vec_id long, label long, codes binary, error long"), history


def digest(book: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def decoded(codes: bytes, book: np.ndarray) -> np.ndarray:
    """The vector that a code stands for: the middle of its grid cells."""
    return (book[np.arange(len(codes)), np.frombuffer(codes, np.uint8)].ravel() + 0.5) / GRID


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the errors of equal labels added up; null labels are equal.

    Counted map-side first, so a label that holds a third of the rows is no one task's; the sums are
    broadcast while they are few and joined by shuffle beyond that.
    """
    sums, _ = write(coded.groupBy(F.col("label").alias("__l")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sized(sums), F.col("label").eqNullSafe(F.col("__l")), "left").drop("__l")
