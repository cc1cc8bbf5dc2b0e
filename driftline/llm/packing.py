"""Bounded-space online packing of tokenised documents into fixed windows.

Every partition keeps at most ``open_windows`` windows. A piece goes to the open window it fills
best; when none has room, the fullest is emitted. What is still open when a partition ends is
packed again, a bounded number of partitions at a time, until one group is left.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import materialize

#: Rows of one packed table: a piece of a document at its place in a sequence.
SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, closed boolean, part long"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("closed", pa.bool_()), ("part", pa.int64())]
)
#: Words whose ids a worker remembers, twice; a matter of speed only.
CACHED_WORDS = 75_000
SPECIAL = "<|endoftext|>"


class Encoder:
    """Byte-level BPE ids as little-endian 32-bit bytes; the ids of whole words are remembered.

    A word with its leading space is always encoded alone, so the ids of a text are those of its
    words, unless white space meets white space; such texts are encoded whole. Texts that hold the
    special token's own string go through the ``tokenizers`` file.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self._file = tokenizer
        self._words: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise LookupError(word)
        if len(self._words) >= CACHED_WORDS:
            old, self._old = self._old, self._words.copy()
            self._words.clear()
            old.clear()
        got = self._words[word] = self._old.get(word) or array("I", self._encode(" " + word)).tobytes()
        return got

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            from tokenizers import Tokenizer

            return array("I", Tokenizer.from_file(self._file).encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        known = self._words
        try:
            if first and first[-1].isspace():
                raise LookupError(first)
            words = [known.get(w) or self._word(w) for w in rest]
        except LookupError:
            return array("I", self._encode(text)).tobytes()
        return b"".join([array("I", self._encode(first)).tobytes(), *words])


@functools.lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str) -> Encoder:
    import public_tokenizers

    path = public_tokenizers.path
    return Encoder(path(tokenizer), path(ranks), public_tokenizers.PATTERN)


class Windows:
    """The open windows of one partition. ``put`` returns the pieces of windows that it emits."""

    def __init__(self, capacity: int, open_windows: int, min_cut: int, first_id: int, part: int):
        self.capacity, self.most, self.min_cut, self.next_id, self.part = capacity, open_windows, min_cut, first_id, part
        self.open: list[tuple[int, list[tuple]]] = []  # free tokens, pieces

    def _rows(self, pieces: list[tuple], closed: bool) -> list[tuple]:
        at, rows = 0, []
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            rows.append((doc, start, n, total, ids, self.next_id, at, closed, self.part))
            at += n
        self.next_id += 1
        return rows

    def put(self, doc: int | None, start: int, ids: bytes, total: int) -> list[tuple]:
        out, wide, at = [], 4 * self.capacity, 0
        while len(ids) - at >= wide:
            out += self._rows([(doc, start, ids[at : at + wide], total)], True)
            start, at = start + self.capacity, at + wide
        ids = ids[at:]
        if not ids:
            return out
        n = len(ids) // 4
        best = min((i for i, w in enumerate(self.open) if w[0] >= n), key=lambda i: self.open[i][0], default=None)
        if best is None and len(self.open) >= self.most:
            free, pieces = self.open.pop(min(range(len(self.open)), key=lambda i: self.open[i][0]))
            if free >= self.min_cut:  # a document may be cut, so its head closes a wide gap
                pieces.append((doc, start, ids[: 4 * free], total))
                start, ids, n = start + free, ids[4 * free :], n - free
            out += self._rows(pieces, True)
            best = min((i for i, w in enumerate(self.open) if w[0] >= n), key=lambda i: self.open[i][0], default=None)
        free, pieces = self.open.pop(best) if best is not None else (self.capacity, [])
        pieces.append((doc, start, ids, total))
        if free == n:
            out += self._rows(pieces, True)
        else:
            self.open.append((free - n, pieces))
        return out

    def end(self, closed: bool = False) -> list[tuple]:
        rows = [r for _, pieces in self.open for r in self._rows(pieces, closed)]
        self.open = []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in ARROW]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = 1024, open_windows: int = 64, min_cut: int = 32, fan_in: int = 16,
    tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """Pieces of all documents at their places in sequences of at most ``capacity`` tokens.

    A document's tokens are its ids followed by id 0. Null text counts as empty and gives that one
    id; a null document id stays null; repeated rows are packed once each; other columns are
    ignored; an empty table gives no rows. Longer documents are cut at full windows. A document is
    cut besides only to close a gap of ``min_cut`` tokens or more in a window about to be emitted.
    ``ids`` holds the piece's ids as little-endian 32-bit integers. Ids of sequences are unique,
    not consecutive. The packed table is written to the shared folder.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, windows, rows, size = encoder(tokenizer, ranks), Windows(capacity, open_windows, min_cut, part << 30, part), [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                size += len(ids)
                rows += windows.put(doc, 0, ids, len(ids) // 4)
                if size >= 4_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
        yield _batch(rows + windows.end())

    def merge(level: int, last: bool):
        def again(key: tuple, table: pa.Table) -> pa.Table:
            part = key[0].as_py()
            windows, rows = Windows(capacity, open_windows, min_cut, (level << 56) + (part << 30), part), []
            for r in table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
                rows += windows.put(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
            return pa.Table.from_batches([_batch(rows + windows.end(closed=last))])

        return again

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    packed = materialize(plain.mapInArrow(first, SCHEMA), "packed")
    tables, left, level = [packed.where("closed")], packed.where("not closed"), 0
    groups = left.agg(F.max("part")).first()[0]
    while groups is not None:
        level, last = level + 1, groups < fan_in

        wider = left.withColumn("part", F.floor(F.col("part") / fan_in))
        left = wider.groupBy("part").applyInArrow(merge(level, last), SCHEMA)
        merged = materialize(left, "packed")
        tables.append(merged.where("closed"))
        left, groups = merged.where("not closed"), None if last else groups // fan_in
    out = functools.reduce(DataFrame.unionByName, tables)
    return out.drop("closed", "part")
