"""Documents with nearly the same word shingles, joined with signature trees.

A pair above the threshold shares one of its rarest shingles, so trees are planted per rare shingle.
A tree's leaves are documents, its nodes hold the OR of their token bitmaps and the range of their
set sizes; two nodes are compared further only if some pair below them could overlap enough and
isn't connected already. Exact copies are one leaf. Large groups are cut into blocks: first every
block is joined with itself, then the blocks that still hold different components with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.components import components
from driftline.llm.joins import sized
from driftline.llm.tables import forget
from driftline.llm.words import NOT_SPACE, blocks, cut, mix, runs, small_batches
from driftline.session import materialize

BUCKET_BITS = 18
BLOCK = 256
BITMAP, WIDE = 8, 32  # 64-bit words of a row's bitmap and of a tree's
LEAF = 8
#: Documents per shingle from which trees are merged first; the size of the components that are merged;
#: so many of each speak for it, dealt so often at most.
CROWD, GROWN, SPEAKERS, DEALS = 16, 4, 3, 4
#: Rows of a group that the last pass takes whole; larger ones are cut into blocks of half that.
CROWDED = 4096
#: Rows of one family that go to one task, and pairs of nodes that are looked at in one step.
ROUTE_ROWS, NODE_PAIRS = 8192, 1 << 16


class Rule(NamedTuple):
    """Two sets link when 100 * intersection >= percent * union; sets are runs of ``words`` words."""

    words: int = 3
    percent: int = 90

    def prefix(self, n: int) -> int:
        """So many of the rarest shingles of a set, one of which any linked set shares."""
        return n - -(-self.percent * n // 100) + 1

    def overlap(self, total):
        """Least intersection of two linked sets whose sizes add up to ``total``."""
        return -(-self.percent * total // (100 + self.percent))

    def linked(self, both, total):
        return 100 * both >= self.percent * (total - both)


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a shorter text is one shingle, one without words none."""
    cutted = cut(texts, NOT_SPACE)
    whole = runs(cutted.hashes, words)
    out = []
    for a, b in zip(cutted.first.tolist(), cutted.end.tolist()):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        else:
            out.append(runs(cutted.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _bitmap(hashes: np.ndarray, longs: int) -> np.ndarray:
    bits = np.zeros(64 * longs, bool)
    bits[hashes % np.uint64(64 * longs)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _thinned(n):
    """A row's bitmap has the shingles whose hash begins with so many zero bits, about 256 of ``n``."""
    return np.ceil(np.log2(np.maximum(n, 256) / 256)).astype(np.int64)


def _fine(s: np.ndarray) -> bytes:
    """Bitmap of all shingles of a set, two to four bits each: a power of two of 64-bit words."""
    return _bitmap(mix(s), max(1, 1 << (max(0, 2 * len(s) - 1)).bit_length() >> 6)).tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the same shingles have at fewer words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _frequencies(docs: DataFrame, rule: Rule) -> np.ndarray:
    """How many shingles of the corpus fall in each of a fixed number of hash buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for block in blocks(batches):
            words = cut(block.column(1).to_pylist(), NOT_SPACE)
            total += np.bincount((runs(words.hashes, rule.words) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    # At most 2 ** BUCKET_BITS rows, whatever the corpus.
    table = docs.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def _described(docs: DataFrame, rule: Rule) -> DataFrame:
    """Size, fingerprint, rarest shingles and bitmap of every document."""
    carried = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, rule))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.minimum(carried.value, (1 << 30) - 1).astype(np.uint64)
        for block in blocks(batches):
            rows = []
            for s in shingles(block.column(1).to_pylist(), rule.words):
                if not len(s):
                    rows.append((0, 0, 0, [], bytes(8 * BITMAP), b""))
                    continue
                # Rare buckets first; any order will do if it is the same for all documents.
                order = (frequency[s >> np.uint64(64 - BUCKET_BITS)] << np.uint64(34)) | (s & np.uint64((1 << 34) - 1))
                k = min(rule.prefix(len(s)), len(s))
                rare = s[np.argpartition(order, k - 1)[:k]] if k < len(s) else s
                marks = np.array([s.sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).view(np.int64)
                some, few = mix(s), int(_thinned(len(s)))
                some = some[some >> np.uint64(64 - few) == 0] if few else some
                rows.append((len(s), *marks.tolist(), rare.view(np.int64), _bitmap(some, BITMAP).tobytes(), _fine(s)))
            n, f1, f2, rare, bits, fine = zip(*rows) if rows else ([],) * 6
            yield pa.record_batch(
                [block.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(list(rare), pa.list_(pa.int64())), pa.array(list(bits), pa.binary()), pa.array(list(fine), pa.binary())],
                names=["id", "n", "f1", "f2", "rare", "bits", "fine"],
            )

    return materialize(docs.mapInArrow(step, "id long, n long, f1 long, f2 long, rare array<long>, bits binary, fine binary"), "ngram-sets")


class Tree:
    """Signature tree of one block. ``sets`` are sorted arrays of shingles."""

    def __init__(self, sets: list[np.ndarray], rule: Rule):
        self.rule, self.sets = rule, sets
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.size = np.array([len(sets[i]) for i in self.order])
        bitmaps = np.array([_bitmap(sets[i], WIDE) for i in self.order])
        spare = self.size - np.bitwise_count(bitmaps).sum(axis=1)
        self.root = list(range(len(sets)))
        # Levels from the leaves up; a node is (first, end) of the documents in order of size.
        self.levels = [(bitmaps, self.size, self.size, spare, 1)]
        span = LEAF
        while self.levels[-1][0].shape[0] > 1:
            bits, low, high, more, width = self.levels[-1]
            step = span // width
            at = np.arange(0, len(bits), step)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at), span))
            span *= LEAF

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def _joined(self, level: int, a: int, b: int) -> bool:
        width = self.levels[level][4]
        first = self.find(a * width)
        return all(self.find(i) == first for k in (a, b) for i in range(k * width, min((k + 1) * width, len(self.order))))

    def _possible(self, level: int, a: int, others: np.ndarray) -> np.ndarray:
        """Nodes of ``others`` below which a document may overlap enough with one below ``a``."""
        bits, low, high, spare, _ = self.levels[level]
        most = np.bitwise_count(bits[others] & bits[a]).sum(axis=1, dtype=np.int64) + np.minimum(spare[others], spare[a])
        most = np.minimum(most, np.minimum(high[others], high[a]))
        near = 100 * np.minimum(high[others], high[a]) >= self.rule.percent * np.maximum(low[others], low[a])
        return others[near & (most >= self.rule.overlap(low[others] + low[a]))]

    def links(self) -> list[tuple[int, int]]:
        """Pairs that link, as many as connect what is connected."""
        out, top = [], len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if self._joined(level, a, b):
                continue
            if level == 0:
                if a != b and self._verified(a, b):
                    self.root[max(self.find(a), self.find(b))] = min(self.find(a), self.find(b))
                    out.append((self.order[a], self.order[b]))
                continue
            ratio, n = self.levels[level][4] // self.levels[level - 1][4], len(self.levels[level - 1][0])
            below = np.arange(b * ratio, min((b + 1) * ratio, n))
            for child in range(a * ratio, min((a + 1) * ratio, n)):
                for other in self._possible(level - 1, child, below[below >= child] if a == b else below).tolist():
                    stack.append((level - 1, child, other))
        return out

    def _verified(self, a: int, b: int) -> bool:
        x, y = self.sets[self.order[a]], self.sets[self.order[b]]
        return bool(self.rule.linked(_common(x, y), len(x) + len(y)))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(y):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _runs_of(keys: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return list(zip(edge.tolist(), np.append(edge[1:], len(keys)).tolist()))


def _groups(batches: Iterator[pa.RecordBatch], key: int, enough: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of about ``enough`` bytes that end where the key changes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        last = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])
        if last:
            yield table.slice(0, last)
        held, size = table.slice(last).to_batches(), table.slice(last).nbytes
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table


LINKS = "a long, b long"


def _link_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _within_blocks(texts: DataFrame, rule: Rule) -> DataFrame:
    """Links inside every block of (``block``, ``id``, ``text``)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 0, 1_000_000):
            ids, sets = table.column(1).to_pylist(), shingles(table.column(2).to_pylist(), rule.words)
            pairs = []
            for a, b in _runs_of(table.column(0).to_numpy()):
                if b - a > 1:
                    pairs += [(ids[a + i], ids[a + j]) for i, j in Tree(sets[a:b], rule).links()]
            yield _link_batch(pairs)

    return texts.repartition("block").sortWithinPartitions("block").mapInArrow(step, LINKS)


def _linked(anchors: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Links inside the trees of (``token``, ``m``, ``id``), each cut into blocks if its ``m`` rows are too many."""
    block = F.xxhash64("token", F.when(F.col("m") > BLOCK, F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / (BLOCK // 2)))))
    blocked = sized(materialize(anchors.select("id", block.alias("block")), "ngram-blocks"))
    return materialize(_within_blocks(docs.join(blocked, "id").select("block", "id", "text"), rule), "ngram-links")


def _blocks_that_may_link(large: DataFrame, rule: Rule) -> DataFrame:
    """Rows of large groups, once per pair of blocks that hold different components of near enough sizes."""
    # Blocks are cut along the sizes of the sets: in steps of the least ratio of two that link, so that
    # only neighbouring steps meet. A component with many rows in a step gets blocks of its own.
    step = F.floor(F.ln("n") / math.log(100 / min(rule.percent, 99)))
    large = large.withColumn("step", step)
    own = large.groupBy("token", "step", "part").agg(F.count("*").alias("k"))
    sizes = own.groupBy("token", "step").agg(F.sum("k").alias("m_step"))
    half = CROWDED // 2
    apart = F.xxhash64("step", "part", F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / half)))
    mixed = F.xxhash64("step", F.pmod(F.xxhash64("part"), F.ceil(F.col("m_step") / half)))
    large = large.join(own, ["token", "step", "part"]).join(sizes, ["token", "step"]).withColumn("blk", F.when(F.col("k") > half, apart).otherwise(mixed))
    large = materialize(large.drop("k", "m_step", "step"), "ngram-large")
    nodes = large.groupBy("token", "blk").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.min("n").alias("low"), F.max("n").alias("high"))
    nodes = materialize(nodes, "ngram-nodes")
    one, two = (nodes.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("blk", "p", "q", "low", "high"))) for k in ("a", "b"))
    pairs = one.join(two, "token").where("blk_a <= blk_b and not (p_a = q_a and p_b = q_b and p_a = p_b)")
    pairs = pairs.where((100 * F.least("high_a", "high_b") >= rule.percent * F.greatest("low_a", "low_b")))
    side = F.when(F.col("blk_a") == F.col("blk_b"), F.array(F.struct(F.col("blk_a").alias("blk"), F.lit(2).alias("side"))))
    side = side.otherwise(F.array(F.struct(F.col("blk_a").alias("blk"), F.lit(0).alias("side")), F.struct(F.col("blk_b").alias("blk"), F.lit(1).alias("side"))))
    sides = pairs.select("token", F.xxhash64("token", "blk_a", "blk_b").alias("pair"), F.inline(side))
    return large.join(sides, ["token", "blk"]).select("least", "pair", "side", "id", "part", "n")


class Level(NamedTuple):
    """Nodes of one height: OR and AND of the bitmaps below, and ranges of sizes, components and thinning."""

    some: np.ndarray
    all: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    thin_low: np.ndarray
    thin_high: np.ndarray


class Signatures:
    """Signature tree over the rows of a group in order of set size; ``levels`` go from the rows up to the root."""

    def __init__(self, n: np.ndarray, part: np.ndarray, bits: np.ndarray, height: int):
        self.order = np.argsort(n, kind="stable")
        n, part, bits, thin = n[self.order], part[self.order], bits[self.order], _thinned(n[self.order])
        self.levels = [Level(bits, bits, n, n, part, part, thin, thin)]
        for _ in range(height):
            x = self.levels[-1]
            at = np.arange(0, len(x.low), LEAF)
            how = (np.bitwise_or, np.bitwise_and, np.minimum, np.maximum, np.minimum, np.maximum, np.minimum, np.maximum)
            self.levels.append(Level(*(f.reduceat(v, at) for f, v in zip(how, x))))


def _may_link(a: Level, b: Level, i: np.ndarray, j: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether some row below node ``i`` of ``a`` may link with one of another component below ``j`` of ``b``."""
    keep = ~((a.first[i] == a.last[i]) & (b.first[j] == b.last[j]) & (a.first[i] == b.first[j]))
    keep &= 100 * np.minimum(a.high[i], b.high[j]) >= rule.percent * np.maximum(a.low[i], b.low[j])
    at = np.flatnonzero(keep)
    i, j = i[at], j[at]
    # Bits that every row on one side has and none on the other are lost to the overlap of any pair.
    lost_a = np.bitwise_count(a.all[i] & ~b.some[j]).sum(axis=1, dtype=np.int64)
    lost_b = np.bitwise_count(b.all[j] & ~a.some[i]).sum(axis=1, dtype=np.int64)
    good = (lost_a <= a.high[i] - rule.overlap(a.high[i] + b.low[j])) & (lost_b <= b.high[j] - rule.overlap(b.high[j] + a.low[i]))
    alike = (a.thin_low[i] == a.thin_high[i]) & (b.thin_low[j] == b.thin_high[j]) & (a.thin_low[i] == b.thin_low[j])
    keep[at] = good | ~alike  # bitmaps of different shingles say nothing
    return keep


def _traversed(a: Signatures, b: Signatures, rule: Rule) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of ``a`` and ``b`` that may link, from the roots down; with itself every pair once."""
    out, top = [], len(a.levels) - 1
    ways = np.arange(LEAF * LEAF)
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        keep = _may_link(a.levels[level], b.levels[level], i, j, rule)
        if level == 0 and a is b:
            keep &= i < j
        i, j = i[keep], j[keep]
        if level == 0:
            out.append((a.order[i], b.order[j]))
            continue
        for k in range(0, len(i), NODE_PAIRS // len(ways)):
            x = (i[k : k + NODE_PAIRS // len(ways), None] * LEAF + ways // LEAF).ravel()
            y = (j[k : k + NODE_PAIRS // len(ways), None] * LEAF + ways % LEAF).ravel()
            real = (x < len(a.levels[level - 1].low)) & (y < len(b.levels[level - 1].low))
            real &= (x <= y) | (a is not b)
            stack.append((level - 1, x[real], y[real]))
    return out


def _across(rows: DataFrame, bits: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different components that sizes and ``bits`` leave open, per group of (``pair``, ``side``).

    Groups of one leaf are compared row by row, many at a time; larger ones by dual traversal of their
    signature tree, or of the trees of both sides.
    """

    def small(key, ids, part, n, bits) -> list[tuple[int, int]]:
        out, thin = [], _thinned(n)
        for shift in range(1, LEAF):
            x = np.arange(max(0, len(key) - shift))
            y = x + shift
            keep = (key[x] == key[y]) & (part[x] != part[y]) & (100 * np.minimum(n[x], n[y]) >= rule.percent * np.maximum(n[x], n[y]))
            x, y = x[keep], y[keep]
            need = rule.overlap(n[x] + n[y])
            both = bits[x] & bits[y]
            lost_x = np.bitwise_count(bits[x] ^ both).sum(axis=1, dtype=np.int64)
            lost_y = np.bitwise_count(bits[y] ^ both).sum(axis=1, dtype=np.int64)
            good = (lost_x <= n[x] - need) & (lost_y <= n[y] - need)
            good |= thin[x] != thin[y]
            out += zip(np.minimum(ids[x], ids[y])[good].tolist(), np.maximum(ids[x], ids[y])[good].tolist())
        return out

    def large(side, ids, part, n, bits) -> list[tuple[int, int]]:
        sides = [np.flatnonzero(side == k) for k in ((2,) if side[0] == 2 else (0, 1))]
        if not all(map(len, sides)):
            return []
        height = max(1, math.ceil(math.log(max(map(len, sides)), LEAF)))
        trees = [Signatures(n[k], part[k], bits[k], height) for k in sides]
        out = []
        for x, y in _traversed(trees[0], trees[-1], rule):
            x, y = ids[sides[0][x]], ids[sides[-1][y]]
            out += zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist())
        return out

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for table in _groups(batches, 0, 1_000_000):
            key, side, ids, part, n = (table.column(k).to_numpy() for k in range(5))
            bits = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint64).reshape(-1, BITMAP)
            if len(told) > 200_000:  # remembering saves rows, forgetting loses none
                told.clear()
            edges = _runs_of(key)
            few = np.zeros(len(key), bool)
            pairs: set[tuple[int, int]] = set()
            for a, z in edges:
                if z - a <= LEAF and side[a] == 2:
                    few[a:z] = True
                else:
                    pairs.update(large(side[a:z], ids[a:z], part[a:z], n[a:z], bits[a:z]))
            pairs.update(small(key[few], ids[few], part[few], n[few], bits[few]))
            fresh = pairs - told
            told |= fresh
            yield _link_batch(list(fresh))

    # Shingles of one family go to few tasks, which tell a pair once however many of them it shares; a
    # large family is dealt over as many as its rows need.
    family = materialize(rows.groupBy("least").agg(F.ceil(F.count("*") / ROUTE_ROWS).alias("routes")), "ngram-routes")
    route = F.xxhash64("least", F.pmod(F.col("pair"), F.col("routes")))
    rows = rows.join(sized(family), "least").join(bits, "id").select("pair", "side", "id", "part", "n", "bits", route.alias("route")).repartition("route").sortWithinPartitions("route", "pair")
    return rows.mapInArrow(step, LINKS).distinct()


def _refined(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The open pairs that bitmaps of all shingles leave open, so that few whole texts have to move.

    A bit that only one of two sets has stands for a shingle that only that set has.
    """
    side = lambda k: classes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("fine").alias(f"f{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "fa", "fb")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4):
            good = []
            for na, nb, fa, fb in zip(block.column(2).to_pylist(), block.column(3).to_pylist(), block.column(4).to_pylist(), block.column(5).to_pylist()):
                x, y = np.frombuffer(fa, np.uint64), np.frombuffer(fb, np.uint64)
                words = min(len(x), len(y))
                x, y = _folded(x, words), _folded(y, words)
                need = rule.overlap(na + nb)
                good.append(int(np.bitwise_count(x & ~y).sum()) <= na - need and int(np.bitwise_count(y & ~x).sum()) <= nb - need)
            keep = pa.array(good, pa.bool_())
            yield pa.record_batch([block.column(0).filter(keep), block.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(step, LINKS)


def _checked(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that link, told by their whole texts."""
    wanted = sized(materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ngram-wanted"))
    texts = materialize(docs.join(wanted, "id").groupBy("id").agg(F.first("text").alias("text")), "ngram-texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 2):
            x, y = (shingles(block.column(k).to_pylist(), rule.words) for k in (2, 3))
            good = [bool(len(p) and rule.linked(_common(p, q), len(p) + len(q))) for p, q in zip(x, y)]
            yield pa.record_batch([block.column(0).filter(pa.array(good, pa.bool_())), block.column(1).filter(pa.array(good, pa.bool_()))], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(step, LINKS)


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rule: Rule = Rule()) -> DataFrame:
    """``id_column``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    The component is the smallest id that links reach. Null texts and texts without words have no
    shingles and are linked with nothing; rows of one id count as one document where they link; a null
    id has a null component and no links; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    described = _described(plain, rule)
    usable = described.where("n > 0 and id is not null")
    classes = materialize(usable.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.first("rare").alias("rare"), F.first("bits").alias("bits"), F.first("fine").alias("fine")), "ngram-classes")
    tokens = classes.select("id", "n", F.explode("rare").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    shared = materialize(tokens.join(shared, "token"), "ngram-tokens")
    # First the trees of every document's most shared rare shingle, in blocks dealt by its hash.
    anchor = shared.groupBy("id").agg(F.max(F.struct("m", "token")).alias("x")).select("id", "x.*")
    anchor = materialize(anchor, "ngram-anchors")
    links = _linked(anchor, plain, rule)
    parts = materialize(components(links), "ngram-parts")
    forget(docs.sparkSession)
    # Blocks and trees are merged by a few documents of each of their components, dealt anew.
    large, before = shared.where(F.col("m") > CROWD), None
    for deal in range(DEALS):
        grown = parts.groupBy("component").agg(F.count("*").alias("k")).where(F.col("k") >= GROWN).select("component")
        held = large.join(parts.join(grown, "component"), large.id == parts.node).select("token", "id", F.col("component").alias("part"))
        met = held.groupBy("token").agg(F.countDistinct("part").alias("parts")).where("parts > 1")
        held = held.join(met, "token")
        # Each component speaks under one shingle, the one that most components share.
        chosen = held.groupBy("part").agg(F.max(F.struct("parts", F.xxhash64("token", F.lit(deal)), "token")).alias("x")).select("part", "x.token")
        by_hash = Window.partitionBy("token", "part").orderBy(F.xxhash64("id", F.lit(deal)))
        speakers = held.join(chosen, ["part", "token"]).withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= SPEAKERS)
        count = speakers.groupBy("token").agg(F.count("*").alias("m"))
        speakers = materialize(speakers.join(count, "token").select("id", "m", "token"), "ngram-speakers")
        n = speakers.count()
        if not n or before and n > 0.9 * before:
            break
        before, links = n, materialize(links.union(_linked(speakers, plain, rule)), "ngram-links")
        parts = materialize(components(links), "ngram-parts")
        forget(docs.sparkSession)
    # Then, per rare shingle, the blocks that hold more than one component.
    rows = shared.join(sized(parts), shared.id == parts.node, "left").select("token", "m", "id", "n", F.coalesce("component", "id").alias("part"))
    mixed = rows.groupBy("token").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("token", "least")
    rows = materialize(rows.join(mixed, "token"), "ngram-rows")
    # A group of one tree meets itself; larger ones are cut, and their blocks are the upper nodes.
    whole = rows.where(F.col("m") <= CROWDED).select("least", F.xxhash64("token").alias("pair"), F.lit(2).alias("side"), "id", "part", "n")
    cut_rows = whole.unionByName(_blocks_that_may_link(rows.where(F.col("m") > CROWDED), rule))
    bits = sized(materialize(classes.select("id", "bits"), "ngram-bits"))
    open_pairs = materialize(_across(cut_rows, bits, rule), "ngram-open")
    forget(docs.sparkSession)
    open_pairs = materialize(_refined(open_pairs, classes, rule), "ngram-refined")
    second = materialize(_checked(open_pairs, plain.where("id is not null"), rule), "ngram-links")
    forget(docs.sparkSession)
    whole = components(links.union(second))
    forget(docs.sparkSession)
    # Copies of a class follow its first document.
    named = classes.join(whole, classes.id == whole.node, "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component"))
    out = described.join(named, ["f1", "f2", "n"], "left")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with their columns; rows without an id stay."""
    groups = near_groups(docs, id_column, text_column, rule)
    later = groups.where(F.col("component_id") != F.col(id_column)).select(F.col(id_column).alias("__later")).distinct()
    later = sized(materialize(later, "ngram-later"))
    return docs.join(later, F.col(f"`{id_column}`") == F.col("__later"), "left_anti")
