import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm.packing import pack


def ids_of(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(packed, want):
    got = packed.toPandas()
    assert sorted(zip(got.groupby("doc_id", dropna=False)["length"].sum())) == sorted((len(v),) for v in want.values())
    for doc, rows in got.groupby("doc_id", dropna=False):
        rows = rows.sort_values("start")
        ids = np.concatenate([np.frombuffer(b, "<u4") for b in rows["ids"]]).tolist()
        assert ids == want[None if np.isnan(doc) else int(doc)]
        assert (rows["length"].cumsum() - rows["length"] == rows["start"]).all() and (rows["doc_tokens"] == len(ids)).all()
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows["length"].cumsum() - rows["length"] == rows["offset"]).all() and rows["length"].sum() <= 1024
    return got


def test_round_trip(docs, texts):
    got = check(pack(docs.repartition(5)), dict(zip(texts, ids_of(texts.values()))))
    full = got["length"].sum() / 1024 / got["sequence_id"].nunique()
    assert full > 0.97


def test_edges(edge, none):
    rows = edge.where("doc_id is null or doc_id <> 8")
    pairs = [tuple(r) for r in rows.select("doc_id", "text").collect()]
    check(pack(rows), dict(zip([i for i, _ in pairs], ids_of([t for _, t in pairs]))))
    twice = pack(edge.where("doc_id = 8")).agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).first()
    assert twice["n"] == 2 * twice["m"]
    assert pack(none).count() == 0


def test_many_partitions_merge(docs):
    packed = pack(docs.repartition(40), open_windows=4, fan_in=4)
    n = packed.agg(F.sum("length") / F.countDistinct("sequence_id")).first()[0]
    assert n > 0.97 * 1024


def test_emitting_a_short_piece_takes_none_of_a_gap():
    from driftline.llm.packing import Windows

    windows = Windows(8, 1, 4, 0, 0)
    out = windows.put(1, 0, b"\1\0\0\0" * 6, 6)
    assert out == []
    out = windows.put(2, 0, b"\2\0\0\0" * 3, 3)  # a gap of 2 is left as padding
    assert [(r[0], r[2], r[6]) for r in out] == [(1, 6, 0)]
    out = windows.put(3, 0, b"\3\0\0\0" * 7, 7)  # a gap of 5 takes the head
    assert [(r[0], r[1], r[2], r[6]) for r in out] == [(2, 0, 3, 0), (3, 0, 5, 3)]
    assert [(r[0], r[1], r[2]) for r in windows.end()] == [(3, 5, 2)]
