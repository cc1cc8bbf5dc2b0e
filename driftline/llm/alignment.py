"""Alignment of two tokenizers' ids on the byte offsets where tokens of both end.

A text's ids are given their cumulative byte ends. The ends of either tokenizer are the keys of a
dictionary that leads to the index behind the token; the intersection of the key sets, sorted, cuts
both id lists into groups. Two tokens are linked when they end at the same byte.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.tables import write
from driftline.llm.words import blocks

#: Words whose ids a worker remembers, twice; a matter of speed only.
REMEMBERED = 150_000
#: Characters of new words that are encoded at a time.
STRETCH = 50_000
SPACE = "▁"
COMMA, BAR, SEMICOLON = b",|;"


class Block(NamedTuple):
    """Alignment of some texts: per text the tokens of either side, groups and links, and the groups as text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: list[bytes]
    groups: list[bytes]


def ends_to_index(sizes: np.ndarray) -> dict[int, int]:
    """Cumulative byte ends of tokens, each with the number of tokens up to it."""
    return dict(zip(np.cumsum(sizes).tolist(), range(1, len(sizes) + 1)))


def cuts(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups end: indexes behind their last tokens in both lists, in order."""
    a, b = ends_to_index(a_sizes), ends_to_index(b_sizes)
    common = sorted(a.keys() & b.keys())
    return tuple(np.fromiter(map(side.__getitem__, common), np.int64, len(common)) for side in (a, b))


class Aligner:
    """Ids and alignment of whole texts under the two tokenizers.

    No piece of ``B`` holds a space behind another character, and ``A`` never joins a character with
    a space behind it. So where single spaces part a text's words, the ids of the text are those of
    its words with their leading spaces, which are remembered. All other texts are encoded whole.
    """

    def __init__(self, ranks: str, pattern: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (max(table.values()) + 1)
        for k, v in table.items():
            self.a_bytes[v] = k
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.width = len(self.b_bytes)
        if any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(self.width)) or len(self.a_bytes) * self.width >= 2**32:
            raise ValueError("the pieces do not part at spaces, or pair codes do not fit 32 bits")
        most = max(len(self.a_bytes), self.width)
        self.figures = np.array([list(f"{i:<6}".encode()) for i in range(most)], np.uint8)
        self.n_figures = np.array([len(str(i)) for i in range(most)], np.int64)
        self.young: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both id lists; None if either side's bytes are not those of ``text`` with a space before it."""
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text, num_threads=1)
        whole = (" " + text).encode("utf-8", "surrogatepass")
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            return None
        return np.array(a, np.uint32), np.array(b, np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: many in one go, or one by one if they don't come back byte for byte."""
        size = np.array([len(w.encode("utf-8", "surrogatepass")) + 1 for w in words], np.int64)
        both = self.encode(" ".join(words))
        if both is not None:
            ends = np.cumsum(size)
            sums = [np.cumsum(side[ids]) for side, ids in zip((self.a_size, self.b_size), both)]
            last = [np.searchsorted(x, ends) for x in sums]
            if all((x[at] == ends).all() for x, at in zip(sums, last)):
                at = [np.concatenate([[0], x + 1]).tolist() for x in last]
                a, b = (ids.tobytes() for ids in both)
                for k, w in enumerate(words):
                    self.young[w] = a[4 * at[0][k] : 4 * at[0][k + 1]], b[4 * at[1][k] : 4 * at[1][k + 1]]
                return
        for w in words:
            alone = self.encode(w)
            self.young[w] = None if alone is None else (alone[0].tobytes(), alone[1].tobytes())

    def _remember(self, words: set[str]) -> None:
        young, old = self.young, self.old
        new, size = [], 0
        for w in sorted(words - young.keys()):
            if w in old:
                young[w] = old[w]
                continue
            new.append(w)
            size += len(w) + 1
            if size >= STRETCH:
                self._learn(new)
                new, size = [], 0
        if new:
            self._learn(new)

    def ids(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of both sides of every text, 32 bits each; texts without tokens have none."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        apart = [t.split(" ") if t else [] for t in texts]
        # An empty word, or white space at a word's end, may belong to the word beside it.
        plain = [bool(w) and all(w) and not any(x[0].isspace() or x[-1].isspace() for x in w) for w in apart]
        self._remember({x for w, p in zip(apart, plain) if p for x in w})
        known, a, b = self.young, [], []
        for text, words, p in zip(texts, apart, plain):
            parts = [known[x] for x in words] if p else [None]
            if None in parts:
                whole = self.encode(text) if text else None
                parts = [] if whole is None else [(whole[0].tobytes(), whole[1].tobytes())]
            a.append(b"".join([x[0] for x in parts]))
            b.append(b"".join([x[1] for x in parts]))
        return a, b

    def __call__(self, texts: list[str | None]) -> Block:
        a_ids, b_ids = self.ids(texts)
        n_a, n_b = (np.array([len(x) // 4 for x in side], np.int64) for side in (a_ids, b_ids))
        a, b = (np.frombuffer(b"".join(side), np.uint32).astype(np.int64) for side in (a_ids, b_ids))
        # Both sides of a text have equal bytes, so texts laid end to end are cut at every text's end, too.
        i, j = cuts(self.a_size[a], self.b_size[b])
        of_text = np.searchsorted(np.cumsum(n_a), i, "left")
        n_groups = np.bincount(of_text, minlength=len(texts))
        # Tokens are not empty, so of a group's slices only the last of either side end together.
        links = (a[i - 1] * self.width + b[j - 1]).astype(np.uint32)
        stops = np.cumsum(n_groups)
        of_links = [links[e - n : e].tobytes() for n, e in zip(n_groups.tolist(), stops.tolist())]
        return Block(n_a, n_b, n_groups, of_links, self._written(a, b, i, j, n_groups, stops))

    def _written(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, n_groups: np.ndarray, stops: np.ndarray) -> list[bytes]:
        """The groups of every text as ``a1,a2|b1;a3|b2``: figures and the mark behind them, side by side."""
        if not len(i):
            return [b""] * len(n_groups)
        of_a, of_b = (np.repeat(np.arange(len(x)), np.diff(x, prepend=0)) for x in (i, j))
        before_b = np.concatenate([[0], j[:-1]])
        place_a, place_b = np.arange(len(a)) + before_b[of_a], np.arange(len(b)) + i[of_b]
        token, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), COMMA, np.uint8)
        token[place_a], token[place_b] = a, b
        mark[place_a[i - 1]], mark[place_b[j - 1]] = BAR, SEMICOLON
        last = place_b[j[stops[n_groups > 0] - 1] - 1]  # of a text, without a mark
        width = self.n_figures[token]
        rows = self.figures[token]
        rows[np.arange(len(token)), width] = mark
        keep = np.arange(rows.shape[1])[None, :] <= width[:, None]
        keep[last, width[last]] = False
        size = width + 1
        size[last] -= 1
        data, ends = rows[keep].tobytes(), np.cumsum(size)[last]
        out, at, ends = [], 0, iter(ends.tolist())
        for n in n_groups.tolist():
            end = next(ends) if n else at
            out.append(data[at:end])
            at = end
        return out


@functools.lru_cache(maxsize=2)
def aligner(ranks: str, pieces: str) -> Aligner:
    import public_tokenizers

    return Aligner(public_tokenizers.path(ranks), public_tokenizers.PATTERN, public_tokenizers.path(pieces))


def pair_counts(links: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pair codes and their numbers of links over all rows of ``links`` (column ``links``).

    Of two tokens that end together one is a suffix of the other, so there are no more pairs than
    both vocabularies have bytes, about twice (bytes have pieces of their own): some hundred
    thousand, whatever the corpus. That bounds a task's counts, the driver's and the broadcast.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, held, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

        def merged():
            codes = np.frombuffer(b"".join(held), np.uint32)
            new, n = np.unique(codes, return_counts=True)
            both, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            return both, np.bincount(place, np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)

        for batch in batches:
            for v in batch.column(0):
                held.append(v.as_py())
                size += len(held[-1])
                if size >= 16_000_000:
                    pairs, counts = merged()
                    held, size = [], 0
        pairs, counts = merged()
        yield pa.record_batch([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

    table = links.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs, n = (table.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pairs)
    return pairs[order], n[order]


def align(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_groups: bool = False,
    ranks: str = "byte_bpe_50k.tiktoken", pieces: str = "piece_bpe_32k.model",
) -> DataFrame:
    """Per row ``id_column``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    ``A`` encodes the text with a space before it, ``B`` the text. A pair's count is the number of
    links of all rows between the two ids; ``count_sum`` adds it up over a row's links, ``n_best``
    counts the links whose pair is its ``B`` id's commonest, ties included. Null and empty texts,
    and those that either tokenizer does not give back byte for byte, have no tokens: zeros and an
    empty digest. Repeated rows are aligned and counted each; a null id stays null; other columns
    are ignored; an empty table gives no rows. ``with_groups`` adds the column ``groups``
    (``a1,a2|b1;a3|b2``). One table with 4 bytes a link is written to the shared folder.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    fixed = f"__id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string" + ", groups string" * with_groups
    names = [c.split()[0] for c in fixed.split(", ")]
    rows = docs.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = aligner(ranks, pieces)
        for block in blocks(batches):
            found = run(block.column(1).to_pylist())
            digest = [hashlib.sha256(x).hexdigest() if x else "" for x in found.groups]
            numbers = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups)]
            text = [pa.array([x.decode() for x in found.groups], pa.string())] * with_groups
            columns = [block.column(0), *numbers, pa.array(digest, pa.string()), *text, pa.array(found.links, pa.binary())]
            yield pa.record_batch(columns, names=[*names, "links"])

    aligned, _ = write(rows.mapInArrow(encode, fixed + ", links binary"), "aligned")
    pairs, n = pair_counts(aligned)
    b = pairs % _pieces(pieces)
    most = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, b, n)
    carried = docs.sparkSession.sparkContext.broadcast((pairs.astype(np.uint32), n, n == most[b]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = carried.value
        for block in blocks(batches, len(names)):
            links = [v.as_py() for v in block.column(len(names))]
            size = np.fromiter((len(v) // 4 for v in links), np.int64, len(links))
            at = np.searchsorted(pairs, np.frombuffer(b"".join(links), np.uint32))
            before = np.concatenate([[0], np.cumsum(size)])
            sums = [np.concatenate([[0], np.cumsum(v[at], dtype=np.int64)]) for v in (best, n)] if len(pairs) else [np.zeros(before[-1] + 1, np.int64)] * 2
            of_row = [pa.array(s[before[1:]] - s[before[:-1]]) for s in sums]
            yield pa.record_batch([*block.columns[: len(names)], pa.array(size), *of_row], names=[*names, "n_links", "n_best", "count_sum"])

    out = aligned.mapInArrow(judge, fixed + ", n_links long, n_best long, count_sum long").withColumnRenamed("__id", id_column)
    return out.select(id_column, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups)


def _pieces(pieces: str) -> int:
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces)).get_piece_size()
