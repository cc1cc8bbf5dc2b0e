"""Quality of texts from trusted positives and unlabelled text alone.

A linear score of measurements of a text minimises the non-negative unbiased risk: the loss of
trusted texts as positives, weighted with the class prior, and the loss of all texts as negatives
less that part of it which stems from the positives among them, held at zero or above. The prior is
estimated from how often all texts score above a trusted text. Every pass over the measurements of
all texts is one Spark job.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.tables import drop, totals, write
from driftline.llm.toxicity import remainder
from driftline.llm.words import NOT_SPACE, blocks, cut

#: Kinds of bytes: lower case, upper case, digit, blank, line end, mark of a sentence, other mark, beyond ASCII.
LOWER, UPPER, DIGIT, BLANK, LINE_END, SENTENCE, MARK, BEYOND = range(8)
KINDS = 8
PROFILE = 6
FEATURES = KINDS * KINDS + PROFILE
#: Standardised measurements are held within this many deviations.
REACH = 8.0
RIDGE, FEW, STEPS, BINS = 0.01, 20.0, 25, 400


def _kinds() -> np.ndarray:
    out = np.full(256, MARK, np.int64)
    out[[*b".,;:?!'\""]] = SENTENCE
    out[[*b" \t\r\v\f"]] = BLANK
    out[10] = LINE_END
    out[128:] = BEYOND
    out[[*range(48, 58)]], out[[*range(65, 91)]], out[[*range(97, 123)]] = DIGIT, UPPER, LOWER
    return out


KIND = _kinds()


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Share of different ones among each owner's hashes; 1 for none."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    all_, kinds = np.bincount(o, minlength=n), np.bincount(o[new], minlength=n)
    return np.where(all_ > 0, kinds / np.maximum(all_, 1), 1.0)


def measure(texts: list[str | None]) -> np.ndarray:
    """A row of measurements per text: roots of the shares of neighbouring kinds of bytes, number and
    length of words, shares of different words and of different lines, words a line, and lines that
    end like a sentence. Null and empty texts measure 0 but for the shares of nothing, which are 1."""
    n = len(texts)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, n)
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(n), size)
    kind = KIND[data]
    same = owner[1:] == owner[:-1]
    pair = (owner[1:] * KINDS * KINDS + kind[:-1] * KINDS + kind[1:])[same]
    shares = np.bincount(pair, minlength=n * KINDS * KINDS).reshape(n, -1) / np.maximum(size - 1, 1)[:, None]
    words = cut(texts, NOT_SPACE)
    n_words = words.end - words.first
    lines = [[x for x in (t or "").split("\n") if x] for t in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, n)
    different = np.fromiter((len(set(x)) for x in lines), np.int64, n)
    seen = np.bincount(owner[kind != BLANK], minlength=n)
    last = np.flatnonzero(np.append((kind[1:] == LINE_END) | ~same, True)) if len(kind) else np.zeros(0, np.int64)
    ends = np.bincount(owner[last[kind[last] == SENTENCE]], minlength=n)
    profile = [
        np.log1p(n_words), seen / np.maximum(n_words, 1), _distinct(words.hashes, np.repeat(np.arange(n), n_words), n),
        np.where(n_lines > 0, different / np.maximum(n_lines, 1), 1.0), np.log1p(n_words / np.maximum(n_lines, 1)), ends / np.maximum(n_lines, 1),
    ]
    return np.concatenate([np.sqrt(shares), np.stack(profile, axis=1)], axis=1).astype(np.float32)


class Model(NamedTuple):
    """Linear score of standardised measurements; the last weight stands alone. ``prior`` is the share of good texts."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        chance = 1 / (1 + np.exp(-np.clip(standard(x, self.mean, self.spread) @ self.weights, -40, 40)))
        return np.round(chance, 12)  # sums of one row differ in their last bits by the batch around it


def standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x.astype(np.float64) - mean) / spread, -REACH, REACH)
    return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            x = np.frombuffer(b"".join(v.as_py() for v in batch.column("x")), np.float32).reshape(-1, FEATURES)
            yield x, np.asarray(batch.column("trusted").to_numpy(zero_copy_only=False), bool)


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    sample: int = 30_000, folds: int = 3, held: int = 1,
) -> Model:
    """Learns from the trusted positives (label 1) and all texts of ``docs``.

    At most ``sample`` labelled rows are used, those with the lowest hashes of the id, and none whose
    remainder of crc32(id) modulo ``folds`` is ``held``; other labels than 1 teach nothing. An id
    with several labels counts with its greatest. The unlabelled side is every row of ``docs``.
    Without positives every score is 0.5 or less; an empty table gives a model that scores 0.
    """
    trusted = (
        labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max(label_column).alias("y"))
        .where((F.col("y") == 1) & (remainder(id_column, folds) != held)).orderBy(F.xxhash64(id_column), id_column).limit(sample)
        .select(F.col(id_column).cast("long").alias("__id"), F.lit(True).alias("trusted"))
    )
    plain = docs.select(F.col(id_column).cast("long").alias("__id"), F.col(text_column).cast("string").alias("text"))
    # At most ``sample`` ids are broadcast, whatever the size of the table.
    rows = plain.join(F.broadcast(trusted), "__id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 0):
            x = measure(block.column(0).to_pylist())
            yield pa.record_batch([pa.array([v.tobytes() for v in x], pa.binary()), block.column(1)], names=["x", "trusted"])

    table, path = write(rows.mapInArrow(measured, "x binary, trusted boolean"), "measured")

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(2 * FEATURES + 2)
        for x, t in _batches(batches):
            v = x.astype(np.float64)
            out += np.concatenate([v.sum(axis=0), (v * v).sum(axis=0), [len(x), t.sum()]])
        return out

    got = totals(table, moments, 2 * FEATURES + 2)
    n, n_trusted = got[-2:]
    if not n_trusted:
        drop(docs.sparkSession, path)
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.append(np.zeros(FEATURES), -40.0), 0.0)
    mean = got[:FEATURES] / n
    spread = np.sqrt(np.maximum(got[FEATURES:-2] / n - mean * mean, 0)) + 1e-6
    wide = FEATURES + 1

    def sides(weights: np.ndarray, hessian_of_trusted: bool):
        """Per side (trusted, all): mean loss as positive and as negative, gradients of both, and the
        curvature of all texts, or of both sides weighing alike."""

        def pass_(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            loss, slope, curve = np.zeros((2, 2)), np.zeros((2, 2, wide)), np.zeros((wide, wide))
            for x, t in _batches(batches):
                z = standard(x, mean, spread)
                s = z @ weights
                p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
                as_good, as_bad = np.logaddexp(0, -s), np.logaddexp(0, s)
                for k, weight in enumerate((t / n_trusted, np.full(len(t), 1 / n))):
                    loss[k] += (weight * as_good).sum(), (weight * as_bad).sum()
                    slope[k] += (weight * (p - 1)) @ z, (weight * p) @ z
                w = p * (1 - p) * (0.5 / n + 0.5 * t / n_trusted if hessian_of_trusted else 1 / n)
                curve += (z * w[:, None]).T @ z
            return np.concatenate([loss.ravel(), slope.ravel(), curve.ravel()])

        got = totals(table, pass_, 4 + 4 * wide + wide * wide)
        return got[:4].reshape(2, 2), got[4 : 4 + 4 * wide].reshape(2, 2, wide), got[4 + 4 * wide :].reshape(wide, wide)

    # Few trusted texts are easily told from all others, so they ask for more shrinkage.
    ridge = np.append(np.full(FEATURES, RIDGE + FEW / n_trusted), 1e-6)

    def descend(objective, hessian_of_trusted: bool) -> np.ndarray:
        """Newton's steps, halved while they do not help."""
        weights, best, step, shrink = np.zeros(wide), None, np.zeros(wide), 1.0
        for _ in range(STEPS):
            trial = weights - shrink * step
            loss, slope, curve = sides(trial, hessian_of_trusted)
            value, gradient = objective(loss, slope)
            value, gradient = value + 0.5 * (ridge * trial * trial).sum(), gradient + ridge * trial
            if best is not None and value > best - 1e-6:
                if shrink < 0.05 or value > best - 1e-6 and abs(value - best) <= 1e-6:
                    break
                shrink /= 4
                continue
            weights, best, shrink = trial, value, 1.0
            step = np.linalg.solve(curve + np.diag(ridge), gradient)
        return weights

    # Trusted texts against all texts; then the share of good texts is at most the least ratio of
    # how many texts and how many trusted texts reach a score.
    apart = descend(lambda loss, slope: (0.5 * (loss[0, 0] + loss[1, 1]), 0.5 * (slope[0, 0] + slope[1, 1])), True)

    def histogram(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, BINS), np.int64)
        for x, t in _batches(batches):
            p = 1 / (1 + np.exp(-np.clip(standard(x, mean, spread) @ apart, -40, 40)))
            at = np.minimum((p * BINS).astype(np.int64), BINS - 1)
            out += np.stack([np.bincount(at[t], minlength=BINS), np.bincount(at, minlength=BINS)])
        return out.ravel()

    prior = least_ratio(*totals(table, histogram, 2 * BINS, np.int64).reshape(2, BINS))

    def risk(loss: np.ndarray, slope: np.ndarray):
        negative = loss[1, 1] - prior * loss[0, 1]
        gradient = prior * slope[0, 0] + (slope[1, 1] - prior * slope[0, 1] if negative > 0 else 0)
        return prior * loss[0, 0] + max(negative, 0.0), gradient

    weights = descend(risk, False)
    drop(docs.sparkSession, path)
    return Model(mean, spread, weights, prior)


def least_ratio(trusted: np.ndarray, everything: np.ndarray, doubt: float = 0.1) -> float:
    """Share of good texts, from histograms of scores: the ratio of the two tails at the threshold
    where the ratio with its margin of error is least."""
    a, b = (np.cumsum(h[::-1])[::-1] / max(h.sum(), 1) for h in (everything, trusted))
    margin = [np.sqrt(np.log(4 / doubt) / (2 * max(h.sum(), 1))) for h in (everything, trusted)]
    fits = b > 0
    ratio = a[fits] / b[fits]
    upper = ratio + (margin[0] + ratio * margin[1]) / b[fits]
    return float(np.clip(ratio[upper.argmin()], 0.01, 0.99))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``score`` and ``predicted`` (1 from 0.5 on) of every row.

    Null and empty texts are measured like any other; repeated rows are scored each and alike; an
    empty table gives no rows; other columns are ignored.
    """
    carried = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("__text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.record_batch([block.column(0), pa.array(carried.value.score(measure(block.column(1).to_pylist())))], names=["__id", "score"])

    kind = rows.schema["__id"].dataType.simpleString()
    out = rows.mapInArrow(step, f"__id {kind}, score double").withColumnRenamed("__id", id_column)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
