"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A text is lower-cased in A-Z and cut where bytes are no word bytes. Bytes of other than ASCII
characters are word bytes, so the cut is the same on bytes as on characters.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of digits, letters and characters beyond ASCII.
ALNUM = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: Words of anything but white space.
NOT_SPACE = np.array([c not in (9, 10, 11, 12, 13, 32) for c in range(256)])
BASE = 0x9E3779B97F4A7C15


class Words(NamedTuple):
    """Hash of every word, and per text its first word and the one after its last."""

    hashes: np.ndarray
    first: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.first)


def _powers(base: int, n: int) -> np.ndarray:
    out, step = np.ones(1, np.uint64), base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % 2**64
    return out[:n]


@functools.lru_cache(maxsize=1)
def _tables(bits: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(BASE, 1 << bits), _powers(pow(BASE, -1, 2**64), 1 << bits)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut(texts: list[str | None], word_bytes: np.ndarray) -> Words:
    """Null counts as empty. A word's hash depends on its folded bytes alone."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]).translate(FOLD), np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in raw), np.int64, len(raw))
    ends = np.cumsum(lengths)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none)
    inside = word_bytes[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    first, end = np.searchsorted(start, ends - lengths), np.searchsorted(start, ends)
    if not len(start):
        return Words(np.zeros(0, np.uint64), first, end)
    up, down = _tables(max(20, int(len(data)).bit_length()))
    values = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]
    values[~inside] = 0
    sums = np.add.reduceat(values, start) * down[start]
    return Words(mix(sums + (stop - start).astype(np.uint64) * np.uint64(BASE)), first, end)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; the last ``n - 1`` are left out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(BASE) + hashes[k : len(hashes) - n + 1 + k])
    return out


def small_batches(spark, rows: int = 1000) -> None:
    """Texts reach Python ``rows`` at a time at most: ten thousand whole texts can be more than a task should hold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def batches_of(spark, rows: int = 1000) -> Iterator[None]:
    """Inside, texts reach Python ``rows`` at a time at most; jobs that are to have it must run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def blocks(batches: Iterable[pa.RecordBatch], text: int = 1, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The rows again, about ``size`` bytes of text at a time."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Memory that a finished task's texts took goes back to the system, so that waiting workers hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def prefixes(texts: list[str | None], words: Words, sizes: tuple[int, ...]) -> np.ndarray:
    """A row per size with the hash of every word's first bytes; 0 for words that aren't longer.

    ``texts`` are those that gave ``words``, cut at :data:`ALNUM`.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]).translate(FOLD), np.uint8)
    edge = np.flatnonzero(np.diff(ALNUM[data], prepend=False, append=False))
    start, length = edge[::2], edge[1::2] - edge[::2]
    out = np.zeros((len(sizes), len(start)), np.uint64)
    code = np.zeros(len(start), np.uint64)
    for k in range(max(sizes)):
        code = code * np.uint64(BASE) + data[np.minimum(start + k, len(data) - 1)] + np.uint64(1)
        if k + 1 in sizes:
            out[sizes.index(k + 1)] = np.where(length > k + 1, mix(code + np.uint64(k + 1)), 0)
    return out
