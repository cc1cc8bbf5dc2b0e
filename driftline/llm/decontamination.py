"""Benchmark passages in documents, found with suffix arrays of the documents.

Every block of documents is a shard: its word suffixes are sorted, every suffix of the benchmark is
binary-searched in it, and matches are carried on to their greatest length. The benchmark reaches
the shards in slices of bounded size; documents never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.words import ALNUM, blocks, cut

WINDOW = 10
MATCH = "array<struct<item_id:string,item_word:int,doc_word:int,words:int>>"
PAIRS = 1_000_000


def _codes(hashes: np.ndarray, level: int) -> np.ndarray:
    """Sort key of words ``4 * level`` to ``4 * level + 3`` after each word; 0 beyond the end."""
    short = (hashes >> np.uint64(48)) | np.uint64(1)
    padded = np.concatenate([short, np.zeros(4 * level + 4, np.uint64)])
    n = len(short)
    at = [padded[4 * level + k : 4 * level + k + n] << np.uint64(48 - 16 * k) for k in range(4)]
    return at[0] | at[1] | at[2] | at[3]


def suffix_array(hashes: np.ndarray, levels: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of all suffixes in the order of their first ``4 * levels`` words, and the keys in that order."""
    keys = [_codes(hashes, k) for k in range(levels)]
    order = np.argsort(keys[0])
    first = keys[0][order]
    same = first[1:] == first[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False)) if len(order) else np.zeros(0, np.int64)
    if len(tied):
        part = order[tied]
        order[tied] = part[np.lexsort([k[part] for k in reversed(keys)])]
    return order, [first, *(k[order] for k in keys[1:])]


def _narrow(keys: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First place in [low, high) whose key is not below the wanted one, for each query."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        less = open_ & (keys[np.minimum(mid, len(keys) - 1)] < wanted)
        low = np.where(less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def search(order: np.ndarray, keys: list[np.ndarray], probes: np.ndarray, suffixes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the suffix array that agrees with each probe suffix in its first ``depth`` words."""
    low, high = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), len(order), np.int64)
    for level, column in enumerate(keys):
        kept = np.clip(depth - 4 * level, 0, 4).astype(np.uint64)
        open_bits = np.where(kept < 4, ~np.uint64(0) >> np.minimum(kept * np.uint64(16), np.uint64(63)), np.uint64(0))
        open_bits = np.where(kept == 0, ~np.uint64(0), open_bits)
        code = _codes(probes, level)[suffixes]
        start, stop = code & ~open_bits, code | open_bits
        top = _narrow(column, start, low, high)
        last = stop == ~np.uint64(0)
        high = np.where(last, high, _narrow(column, np.where(last, stop, stop + np.uint64(1)), top, high))
        low = top
    return low, high


class Probes:
    """The suffixes of one slice of the benchmark that are long enough to be searched for."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int):
        words = cut([text for _, text in rows], ALNUM)
        sizes = words.end - words.first
        self.ids = [i or "" for i, _ in rows]
        # A word no document has separates the items; a suffix never runs on into the next one.
        self.hashes = words.hashes
        self.item = np.repeat(np.arange(len(rows)), sizes)
        self.left = np.repeat(words.end, sizes) - np.arange(len(self.hashes))
        self.need = np.minimum(np.repeat(sizes, sizes), window)
        self.word = np.arange(len(self.hashes)) - np.repeat(words.first, sizes)
        self.suffixes = np.flatnonzero(self.left >= self.need)

    def matches(self, words, levels: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Document word, probe and length of every longest match, some at a time."""
        if not len(self.suffixes) or not len(words.hashes):
            return
        order, keys = suffix_array(words.hashes, levels)
        sizes = words.end - words.first
        room = np.repeat(words.end, sizes) - np.arange(len(words.hashes))
        begins = np.zeros(len(words.hashes) + 1, bool)
        begins[words.first] = True
        low, high = search(order, keys, self.hashes, self.suffixes, self.need[self.suffixes])
        found = np.flatnonzero(high > low)
        total = np.cumsum((high - low)[found])
        at = 0
        while at < len(found):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
            for place, probe in self._split(order, low, high, found[at:to]):
                yield self._extend(words.hashes, room, begins, place, probe)
            at = to

    def _split(self, order, low, high, picked) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(picked) == 1:
            q = picked[0]
            for a in range(low[q], high[q], PAIRS):
                place = order[a : min(a + PAIRS, high[q])]
                yield place, np.full(len(place), self.suffixes[q])
            return
        counts = (high - low)[picked]
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[picked], counts)
        yield order[at], np.repeat(self.suffixes[picked], counts)

    def _extend(self, hashes, room, begins, place, probe) -> tuple[np.ndarray, ...]:
        most = np.minimum(room[place], self.left[probe])
        # Only where the match can't begin one word earlier is it a longest one.
        earlier = (self.word[probe] > 0) & ~begins[place]
        earlier &= hashes[np.maximum(place - 1, 0)] == self.hashes[np.maximum(probe - 1, 0)]
        # A short item is one window: nothing before its first word.
        place, probe, most = place[~earlier], probe[~earlier], most[~earlier]
        length, live, k = np.zeros(len(place), np.int64), np.arange(len(place)), 0
        while len(live):
            live = live[most[live] > k]
            live = live[hashes[place[live] + k] == self.hashes[probe[live] + k]]
            length[live] = k = k + 1
        good = length >= self.need[probe]
        return place[good], probe[good], length[good]


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def find_matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_bytes: int = 8_000_000, carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit``, ``items`` and ``matches``.

    A match is a longest run of words common to a document and an item, of ``window`` words at
    least, or the whole item if that is shorter; ``n_hit`` counts the document's words inside
    matches, ``items`` has the ids, as sorted strings. Null and empty texts have no words; an item
    without words matches nothing, a null item id counts as the empty string; rows of one id are
    judged each for itself; empty tables give no row or no match; other columns are ignored, or
    with ``carry`` kept as the struct ``row``.
    """
    items = benchmark.select(F.col(item_column).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = 1 + size // slice_bytes
    out = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.array().cast(MATCH).alias("matches"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []),
    )
    kept = out.schema["doc_id"].dataType.simpleString()
    passenger = f", row {out.schema['row'].dataType.simpleString()}" if carry else ""
    arrow_match = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())]))
    levels = -(-window // 4)
    for k in range(slices):
        # A slice has a bounded number of bytes, whatever the size of the benchmark.
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k) if slices > 1 else items
        carried = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])
        last = k == slices - 1

        def step(batches: Iterator[pa.RecordBatch], carried=carried, last=last) -> Iterator[pa.RecordBatch]:
            probes = Probes(carried.value, window)
            for block in blocks(batches):
                words = cut(block.column(1).to_pylist(), ALNUM)
                owner = np.repeat(np.arange(len(words)), words.end - words.first)
                found: dict[int, list[dict]] = {}
                for place, probe, length in probes.matches(words, levels):
                    doc = owner[place]
                    for d, p, q, n in zip(doc.tolist(), (place - words.first[doc]).tolist(), probe.tolist(), length.tolist()):
                        found.setdefault(d, []).append({"item_id": probes.ids[probes.item[q]], "item_word": int(probes.word[q]), "doc_word": p, "words": n})
                before = block.column(2)
                if slices > 1:
                    for d in np.flatnonzero(np.asarray(pc.list_value_length(before)) > 0).tolist():
                        found[d] = before[d].as_py() + found.get(d, [])
                matches = pa.array([found.get(d, ()) for d in range(len(words))], arrow_match)
                if not last:
                    yield pa.record_batch([block.column(0), block.column(1), matches, *block.columns[3:]], names=block.schema.names)
                    continue
                hit, names = np.zeros(len(words), np.int64), [()] * len(words)
                for d, spans in found.items():
                    hit[d] = _covered([(m["doc_word"], m["doc_word"] + m["words"]) for m in spans])
                    names[d] = sorted({m["item_id"] for m in spans})
                yield pa.record_batch(
                    [block.column(0), pa.array(words.end - words.first), pa.array(hit), pa.array(names, pa.list_(pa.string())), matches, *block.columns[3:]],
                    names=["doc_id", "n_words", "n_hit", "items", "matches", *block.schema.names[3:]],
                )

        schema = f"doc_id {kept}, n_words long, n_hit long, items array<string>, matches {MATCH}" if last else f"doc_id {kept}, text string, matches {MATCH}"
        out = out.mapInArrow(step, schema + passenger)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with their columns."""
    return find_matches(docs, benchmark, carry=True, **names).where("n_hit = 0").select("row.*")
