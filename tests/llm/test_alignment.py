import hashlib
from collections import Counter

import numpy as np
import pytest

from driftline.llm.alignment import align, cuts, pair_counts
from driftline.llm.q_alignment import op11_tokenizer_alignment

MORE = ["a  b", " led by space", "trail ", "tab\tand\nline \n end", "▁ is no space", "<s> </s> <unk> <0x41> <|endoftext|>", "\0x", "ﬁ ½ é　b", "it's we'll 12 345,678"]


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    names = {v: k for k, v in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def pieces(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def both(text):
        if not text:
            return [], []
        x = [(i, bytes(letters[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, pieces(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (x, y) if b"".join(v for _, v in x) == whole == b"".join(v for _, v in y) else ([], [])

    return both


def plainly(texts, both):
    """Every pair of tokens is compared by its end."""
    tokens = [both(t) for t in texts]
    ends = [[[sum(len(v) for _, v in side[: k + 1]) for k in range(len(side))] for side in t] for t in tokens]
    links = [[(x[0], y[0]) for x, e in zip(t[0], es[0]) for y, f in zip(t[1], es[1]) if e == f] for t, es in zip(tokens, ends)]
    count = Counter(p for k in links for p in k)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (x, y), (ea, eb), k in zip(tokens, ends, links):
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            u, v = ea.index(e) + 1, eb.index(e) + 1
            groups.append(",".join(str(t[0]) for t in x[i:u]) + "|" + ",".join(str(t[0]) for t in y[j:v]))
            i, j = u, v
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        out.append((len(x), len(y), len(groups), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_cuts():
    assert [x.tolist() for x in cuts(np.array([2, 1, 3]), np.array([3, 1, 2]))] == [[2, 3], [1, 3]]
    assert [x.tolist() for x in cuts(np.array([], int), np.array([], int))] == [[], []]


def test_query_against_every_pair(spark, sf, docs, texts, encoders):
    short = {i: t for i, t in texts.items() if len(t or "") < 3000}
    few = spark.createDataFrame(list(short.items()), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align(few).collect()}
    assert got == dict(zip(short, plainly(list(short.values()), encoders)))
    whole = op11_tokenizer_alignment(spark, sf).collect()
    assert sorted(r["doc_id"] for r in whole) == sorted(texts)
    assert [r["groups_sha256"] for r in whole if r["doc_id"] in short] != [] and all(got[r["doc_id"]][6] == r["groups_sha256"] for r in whole if r["doc_id"] in short)


def test_odd_texts(spark, encoders):
    texts = [*MORE, *MORE[:2], None, "", "word " * 2000 + "end", "x" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r[c] for c in COLUMNS) for r in align(rows).orderBy("doc_id").collect()]
    assert got == plainly(texts, encoders)
    assert got[4] == (0, 0, 0, 0, 0, 0, "")


def test_edges(spark, edge, none):
    got = align(edge, with_groups=True)
    rows = got.collect()
    assert len(rows) == edge.count() and got.columns == ["doc_id", *COLUMNS, "groups"]
    same = [tuple(r) for r in rows if r["doc_id"] == 8]
    assert len(same) == 2 and same[0] == same[1]
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in rows if r["n_a"])
    assert align(none).count() == 0


def test_pairs_are_counted_over_all_rows(spark):
    codes = [np.array([7, 7, 4_000_000_000], np.uint32), np.array([4_000_000_000], np.uint32), np.zeros(0, np.uint32)]
    rows = spark.createDataFrame([(c.tobytes(),) for c in codes], "links binary").repartition(3)
    pairs, n = pair_counts(rows)
    assert pairs.tolist() == [7, 4_000_000_000] and n.tolist() == [2, 2]
