"""Language of texts by cross-parsing against suffix automata.

The training text of every language becomes a suffix automaton. A text is parsed into the longest
phrases that occur in the training text; the language that needs the fewest, in relation to what a
text of its training length would give, wins. Texts are parsed in blocks of equal length, many
blocks side by side.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.toxicity import remainder
from driftline.llm.words import blocks, mix

UNKNOWN = "und"
#: A block ends a phrase, so that one very long text is parsed like many short ones.
BLOCK = 256
NO_LETTER = re.compile(r"[\W\d_]+")


class Model(NamedTuple):
    """The automata of all languages side by side. Transitions stand in a hash table of keys
    ``state * width + symbol``; ``slots`` holds the keys, -1 where free, ``targets`` the next states."""

    languages: list[str]
    symbols: np.ndarray
    slots: np.ndarray
    targets: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    @property
    def width(self) -> int:
        return len(self.symbols) + 1

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is no transition."""
        key = state * self.width + symbol
        out = np.full(key.shape, -1, np.int64)
        at, left = _slot(key.ravel(), len(self.slots)), np.arange(key.size)
        flat, keys = out.ravel(), key.ravel()
        while len(left):
            found = self.slots[at]
            hit = found == keys[left]
            flat[left[hit]] = self.targets[at[hit]]
            more = ~hit & (found >= 0)
            left, at = left[more], (at[more] + 1) & (len(self.slots) - 1)
        return flat.reshape(key.shape)


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def hashed(keys: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash table with linear probing of distinct keys, a quarter full at most."""
    size = 1 << max(4, int(4 * len(keys)).bit_length())
    slots, values = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    at, left = _slot(keys, size), np.arange(len(keys))
    while len(left):
        free = slots[at] < 0
        place, first = np.unique(np.where(free, at, -1), return_index=True)
        first = first[place >= 0]  # one key per free slot
        slots[at[first]], values[at[first]] = keys[left[first]], targets[left[first]]
        rest = np.ones(len(left), bool)
        rest[first] = False
        left, at = left[rest], (at[rest] + 1) & (size - 1)
    return slots, values


def plain(text: str | None) -> str:
    """Lower case, with one space for everything between letters."""
    return NO_LETTER.sub(" ", (text or "").lower()).strip()


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is the root."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in steps[p]:
            steps[p][s] = new
            p = link[p]
        if p >= 0:
            q = steps[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and steps[p].get(s) == q:
                    steps[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return steps


def fit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", texts: int = 120, piece: int = 120, sample: F.Column | None = None) -> Model:
    """Automata of at most ``texts`` pieces of ``piece`` characters per language.

    The pieces come from the labelled rows whose text has the lowest hashes; copies count once. A piece
    is cut from a text at a place that its hash chooses, so what many texts begin with does not teach
    instead of them. Every symbol of the pieces counts, however many a language has. ``sample`` limits
    the rows to learn from. Rows without a language or text teach nothing.
    """
    known = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).rlike(r"\p{L}"))
    known = known if sample is None else known.where(sample)
    known = known.select(F.col(lang_column).cast("string").alias("lang"), F.xxhash64(text_column).alias("h"), F.col(text_column).cast("string").alias("t"))
    room = F.greatest(F.char_length("t") - piece, F.lit(0)) + 1
    known = known.select("lang", "h", F.substring(F.col("t"), F.pmod(F.xxhash64("h"), room).cast("int") + 1, F.lit(4 * piece)).alias("piece"))
    # A share of the hash space that holds a few times the texts wanted; copies fall away before they move.
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    share = known.join(F.broadcast(sizes), "lang").where((F.col("h").cast("double") / 2.0**63 + 1) / 2 < 4.0 * texts / F.col("n") + 1e-9)
    first = share.groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= texts)
    rows = ranked.select("lang", "piece").orderBy("lang", "r").collect()
    joined: dict[str, list[str]] = {}
    for lang, text in rows:
        joined.setdefault(lang, []).append(plain(text)[:piece])
    languages = sorted(joined)
    if not languages:
        none = np.zeros(0, np.int64)
        return Model([], np.zeros(0, np.int32), *hashed(none, none), none, np.zeros(0))
    corpora = {k: np.frombuffer((" ".join(v) + " ").encode("utf-32-le"), np.int32) for k, v in joined.items()}
    symbols = np.unique(np.concatenate(list(corpora.values())))
    keys, targets, roots, at = [], [], [], 0
    for k in languages:
        steps = suffix_automaton(_codes(corpora[k], symbols).tolist())
        for state, out in enumerate(steps, at):
            keys += [state * (len(symbols) + 1) + s for s in out]
            targets += [at + t for t in out.values()]
        roots.append(at)
        at += len(steps)
    bits = np.array([math.log2(max(2, len(corpora[k]))) for k in languages])
    return Model(languages, symbols, *hashed(np.array(keys, np.int64), np.array(targets, np.int64)), np.array(roots), bits)


def _codes(points: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    if not len(symbols):
        return np.zeros(len(points), np.int64)
    at = np.minimum(np.searchsorted(symbols, points), len(symbols) - 1)
    return np.where(symbols[at] == points, at + 1, 0)


def phrases(model: Model, texts: list[str]) -> np.ndarray:
    """Phrases that each text needs in each language, a row per text."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    if not sizes.sum() or not len(model.languages):
        return out
    n = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), n)
    grid = np.zeros((n.sum(), BLOCK), np.int64)
    length = np.full(n.sum(), BLOCK, np.int64)
    length[np.cumsum(n)[n > 0] - 1] = (sizes - (n - 1) * BLOCK)[n > 0]
    codes = _codes(np.concatenate(points), model.symbols)
    filled = np.arange(BLOCK)[None, :] < length[:, None]
    grid[filled] = codes
    order = np.argsort(-length, kind="stable")
    grid, length, owner = np.ascontiguousarray(grid[order].T), length[order], owner[order]
    # From the roots, all symbols at once; code 0 is a symbol never seen.
    begin = model.step(np.repeat(model.roots[:, None], model.width, axis=1), np.broadcast_to(np.arange(model.width), (len(model.roots), model.width)))
    roots = np.broadcast_to(model.roots[:, None], (len(model.roots), len(owner)))
    state, count = roots.copy(), np.zeros(roots.shape, np.int32)
    live = np.searchsorted(-length, -np.arange(BLOCK), "left")  # blocks longer than each place
    for k in range(int(length.max())):
        m = live[k]
        symbol = grid[k, :m][None, :]
        step = model.step(state[:, :m], symbol)
        stuck = step < 0
        # A phrase begins at the root, or with the symbol that the one before could not take. A symbol
        # that a language never had leads back to the root and counts twice, as it has to be spelled
        # out besides; or else it would cost no more than a known one that stands alone.
        again = begin[:, grid[k, :m]]
        count[:, :m] += (stuck | (state[:, :m] == roots[:, :m])).astype(np.int32) + (stuck & (again < 0))
        state[:, :m] = np.where(stuck, np.where(again < 0, roots[:, :m], again), step)
    for j in range(len(model.languages)):
        out[:, j] = np.bincount(owner, count[j], minlength=len(texts)).astype(np.int64)
    return out


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``lang_pred`` and ``score`` of every row.

    Null texts and texts without a letter give ``und`` with score 0; ties go to the first language
    by name; repeated rows are judged each; an empty table gives no rows; without any language
    learned everything is ``und``; other columns are ignored. ``score`` is the winner's share when
    every phrase that it saves against the others halves their chance, in (0, 1].
    """
    carried = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = carried.value
        for block in blocks(batches, size=2_000_000):
            texts = [plain(t) for t in block.column(1).to_pylist()]
            known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if len(m.languages):
                cost = phrases(m, texts) * m.bits[None, :]
                best = cost.argmin(axis=1)
                share = 1 / np.exp2(np.maximum((cost.min(axis=1, keepdims=True) - cost) / m.bits.max(), -60)).sum(axis=1)
                score = np.where(known, share, 0.0)
                names = [m.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
            yield pa.record_batch([block.column(0), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(step, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def held_out(id_column: str = "doc_id") -> F.Column:
    return remainder(id_column, 3) == 1
