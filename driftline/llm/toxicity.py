"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are words, or the heads of words where these tell more. Their log-odds between toxic and
clean labelled texts have a Dirichlet prior taken from the counts of the whole corpus. A linear scan
finds every maximal-scoring passage; extreme-value statistics tell which are significant; their sum
is calibrated on labelled texts that were not counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.words import ALNUM, blocks, cut, prefixes

HEADS = (4, 5, 6)
LEAST_TEXTS = 4
LEAST_ODDS = 1.5
LEAST_Z = 4.5
PRIOR = 10
#: A passage is significant if a clean text of that length has one as good with this chance at most.
SIGNIFICANT = 0.05
STEP, REACH = 0.25, 60.0


class Model(NamedTuple):
    """``tokens`` (sorted hashes) with their ``weights`` and ``strength``; all others weigh ``rest``."""

    tokens: np.ndarray
    weights: np.ndarray
    strength: np.ndarray
    rest: float
    decay: float
    scale: float
    slope: float = 1.0
    offset: float = 0.0


def remainder(id_column: str, by: int) -> F.Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def _features(texts: list[str | None]):
    words = cut(texts, ALNUM)
    return words, np.vstack([words.hashes[None, :], prefixes(texts, words, HEADS)])


def _places(tokens: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index in the sorted ``tokens``, or -1. A table of head bits turns most away at once."""
    out = np.full(wanted.shape, -1, np.int32)
    if not len(tokens):
        return out
    head = np.zeros(1 << 20, bool)
    head[tokens >> np.uint64(44)] = True
    maybe = head[wanted >> np.uint64(44)]
    some = wanted[maybe]
    at = np.minimum(np.searchsorted(tokens, some), len(tokens) - 1)
    out[maybe] = np.where(tokens[at] == some, at, -1)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _training(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, sample: int, folds: int) -> DataFrame:
    """Texts with ``y``: the label of the sampled rows, null for the others, and their ``fold``."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col(id_column).isNotNull())
        .groupBy(id_column).agg(F.max("toxic").alias("y")).withColumn("fold", remainder(id_column, folds)).where("fold <> 0")
        .orderBy(F.xxhash64(id_column), id_column).limit(sample)
    )
    known = known.select(F.col(id_column).cast("long").alias("__id"), F.col("y").cast("int"), F.col("fold").cast("int"))
    plain = docs.select(F.col(id_column).cast("long").alias("__id"), F.col(text_column).cast("string").alias("text"))
    # At most ``sample`` rows of two numbers and an id are broadcast, whatever the size of the table.
    return plain.join(F.broadcast(known), "__id", "left").select("__id", "text", "y", "fold")


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = 30_000, folds: int = 5) -> Model:
    """Learns from at most ``sample`` labelled rows, those with the lowest hashes of the id, whose
    remainder of crc32(id) modulo ``folds`` is not 0. Remainder 1 calibrates, the others are counted.
    The prior counts every row of ``docs``. Without toxic or without clean rows every score is the
    share of toxic labels, or 0.
    """
    rows = _training(docs, labels, id_column, text_column, sample, folds)

    def toxic_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words, marks = _features(block.column(1).to_pylist())
            owner = np.repeat(np.arange(len(words)), words.end - words.first)
            seen, owners = marks.ravel(), np.tile(owner, len(marks))
            order = np.lexsort((owners, seen))
            seen, owners = seen[order], owners[order]
            once = np.ones(len(seen), bool)
            once[1:] = (seen[1:] != seen[:-1]) | (owners[1:] != owners[:-1])
            token, n = np.unique(seen[once & (seen > 0)], return_counts=True)
            yield pa.record_batch([pa.array(_signed(token)), pa.array(n)], names=["token", "n"])

    toxic = rows.where("fold > 1 and y = 1").mapInArrow(toxic_tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    # A token of the sample at most; the sample is bounded.
    found = toxic.where(F.col("n") >= LEAST_TEXTS).toPandas()
    tokens = np.sort(found["token"].to_numpy(np.int64).view(np.uint64))
    carried = docs.sparkSession.sparkContext.broadcast(tokens)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts per token: toxic, clean, all; token -1 has the sums over all tokens, -2 the texts."""
        tokens = carried.value
        sums, total = np.zeros((3, len(tokens)), np.int64), np.zeros((2, 3), np.int64)
        for block in blocks(batches):
            y = np.array(block.column(2).fill_null(-1))
            y[np.asarray(block.column(3).fill_null(0)) < 2] = -1
            words, marks = _features(block.column(1).to_pylist())
            owner = np.repeat(np.arange(len(words)), words.end - words.first)
            at = _places(tokens, marks)
            kind, where = np.nonzero(at >= 0)
            pair = np.unique(owner[where].astype(np.int64) * max(1, len(tokens)) + at[kind, where])
            text, token = pair // max(1, len(tokens)), pair % max(1, len(tokens))
            size = words.end - words.first
            for k, mine in enumerate((y == 1, y == 0, y > -2)):
                sums[k] += np.bincount(token[mine[text]], minlength=len(tokens))
                total[0, k] += size[mine].sum()
                total[1, k] += mine.sum()
        kept = np.flatnonzero(sums.any(axis=0))
        columns = np.concatenate([np.vstack([kept, sums[:, kept]]), np.array([[-1, *total[0]], [-2, *total[1]]]).T], axis=1)
        yield pa.record_batch([pa.array(c) for c in columns], names=["token", "toxic", "clean", "all"])

    table = rows.mapInArrow(counts, "token long, toxic long, clean long, all long").groupBy("token")
    table = table.agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "all")]).toPandas().set_index("token").astype(float)
    size, texts = table.loc[-1], table.loc[-2]
    table = table.drop([-1, -2])
    tokens = tokens[table.index.to_numpy(np.int64)]
    t, c = table["toxic"].to_numpy(), table["clean"].to_numpy()
    if not texts["toxic"] or not texts["clean"]:
        share = 0.0 if not texts["toxic"] else 1.0
        return Model(tokens[:0], t[:0], t[:0], -0.01, 1.0, 1.0, 0.0, math.log((share + 1e-6) / (1 - share + 1e-6)))
    # Dirichlet prior: the corpus's rate of the token, worth PRIOR texts of either class.
    prior = PRIOR * np.maximum(table["all"].to_numpy(), 1) / texts["all"]
    nt, nc = texts["toxic"] + PRIOR, texts["clean"] + PRIOR
    odds = np.log((t + prior) / np.maximum(nt - t - prior, 0.5)) - np.log((c + prior) / np.maximum(nc - c - prior, 0.5))
    both = np.clip((t + c) / (texts["toxic"] + texts["clean"]), 1e-9, 1 - 1e-9)
    z = (t / texts["toxic"] - c / texts["clean"]) / np.sqrt(both * (1 - both) * (1 / texts["toxic"] + 1 / texts["clean"]))
    chosen = np.flatnonzero((z >= LEAST_Z) & (odds >= LEAST_ODDS))
    chosen = chosen[np.argsort(tokens[chosen])]
    weights, strength = odds[chosen], z[chosen]
    share = np.clip(c[chosen] / max(size["clean"], 1), 1e-12, None)
    # In clean texts the mean score has to be below 0, or passages would grow without end.
    rest = -0.02 - 2 * float((share * weights).sum())
    decay = _decay(np.append(weights, rest), np.append(share, max(1e-9, 1 - share.sum())))
    model = Model(tokens[chosen], weights, strength, rest, decay, 0.1)
    binned = _scored(rows.where("fold = 1"), model, ["y"]).select("y", F.round(F.col("evidence") / STEP).alias("bin"))
    return model._replace(**_platt(binned.groupBy("y", "bin").count().toPandas()))


def _decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(decay * score)) = 1."""
    share = share / share.sum()
    total = lambda x: float((share * np.exp(np.minimum(x * scores, 600))).sum()) - 1
    low, high = 0.0, 1.0
    while total(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 0 else (low, mid)
    return max(high, 0.05)


def _platt(table) -> dict[str, float]:
    """Logistic fit of the label on the binned evidence, with a little shrinkage."""
    if not len(table):
        return {}
    x, y, n = (table[k].to_numpy(float) for k in ("bin", "y", "count"))
    x = x * STEP
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((y - p) * n * x).sum() - 0.1 * a, ((y - p) * n).sum() - 0.1 * b])
        w = p * (1 - p) * n
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
    return {"slope": max(float(a), 0.0), "offset": float(b)}


def segments(gains: list[float], before: list[float]) -> list[tuple[int, int, float]]:
    """Every maximal-scoring run, as first and last index among the positive tokens and its score.

    ``gains`` are the scores of the positive tokens, ``before`` the sums over all that stands before
    each of them. One pass; each candidate keeps the sums to its left and at its right end.
    """
    out: list[tuple[int, int, float, float]] = []
    for i, (gain, left) in enumerate(zip(gains, before)):
        first, right = i, left + gain
        while True:
            j = next((k for k in range(len(out) - 1, -1, -1) if out[k][2] < left), None)
            if j is None or out[j][3] >= right:
                out.append((first, i, left, right))
                break
            first, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, right - left) for a, b, left, right in out]


def _scored(rows: DataFrame, model: Model, keep: list[str], text_column: str = "text") -> DataFrame:
    """``keep``, ``evidence`` and ``passages`` (first word, words, score) of every row."""
    carried = rows.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    span = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("score", pa.float64())]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = carried.value
        for block in blocks(batches, len(keep)):
            words, marks = _features(block.column(len(keep)).to_pylist())
            size = words.end - words.first
            weight = np.full(len(words.hashes), m.rest)
            at = _places(m.tokens, marks)
            best = np.zeros(len(words.hashes))
            for row in at:  # of a word and its heads the one that tells most
                better = np.flatnonzero(row >= 0)
                better = better[m.strength[row[better]] > best[better]]
                best[better], weight[better] = m.strength[row[better]], m.weights[row[better]]
            cost = np.log(m.scale * (size + 1.0))
            evidence, spans = -cost, [()] * len(words)
            up = np.flatnonzero(weight > 0)
            total = np.cumsum(weight)
            owner = np.searchsorted(words.end, up, "right")
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(up))):
                d, mine = owner[a], up[a:b]
                found = segments(weight[mine].tolist(), (total[mine] - weight[mine]).tolist())
                gains = [m.decay * s - cost[d] for *_, s in found]
                good = [g for g in gains if -math.expm1(-math.exp(-g)) <= SIGNIFICANT]
                evidence[d] = sum(good) if good else max(gains)
                spans[d] = [
                    {"word": int(mine[f] - words.first[d]), "words": int(mine[e] - mine[f] + 1), "score": s}
                    for (f, e, s), g in zip(found, gains) if -math.expm1(-math.exp(-g)) <= SIGNIFICANT
                ]
            yield pa.record_batch(
                [*block.columns[: len(keep)], pa.array(np.clip(evidence, -REACH, REACH)), pa.array(spans, span)], names=[*keep, "evidence", "passages"]
            )

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "evidence double", "passages array<struct<word:long,words:long,score:double>>"])
    return rows.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_column}`").cast("string").alias("__text")).mapInArrow(step, schema)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", carry: bool = False) -> DataFrame:
    """``id_column``, ``score``, ``predicted`` and the significant ``passages`` of every row of ``docs``.

    Null and empty texts have no token and get the score of no evidence; repeated rows are scored
    each; an empty table gives no rows; other columns are left out, or with ``carry`` all are kept
    in the struct ``row``.
    """
    rows = docs.select(F.col(id_column).alias("id"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []), F.col(text_column).alias("__t"))
    out = _scored(rows, model, ["id", "row"] if carry else ["id"], "__t")
    chance = 1 / (1 + F.exp(-(F.col("evidence") * model.slope + model.offset)))
    out = out.select(F.col("id").alias(id_column), chance.alias("score"), (chance >= 0.5).cast("int").alias("predicted"), "passages", *(["row"] if carry else []))
    return out


def keep_clean(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns."""
    return score(docs, fit(docs, labels, **names), carry=True, **names).where("predicted = 0").select("row.*")
