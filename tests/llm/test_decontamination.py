import random
import re

from driftline.llm.decontamination import decontaminate, find_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        q = words(t)
        k = min(10, len(q))
        for a in range(len(q) - k + 1 if k else 0):
            for b in range(len(w) - k + 1):
                if w[b : b + k] == q[a : a + k]:
                    hit |= set(range(b, b + k))
                    ids.add(str(i) if i is not None else "")
    return len(w), len(hit), sorted(ids)


def test_small_alphabet(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "é"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 3, 5, 9, 10, 11, 12, 14, 20, 0])]
    rows = [(i, text(rng.randint(0, 60))) for i in range(120)]
    rows += [(200 + i, f"{text(5)} {items[i][1]} {text(4)}") for i in range(3, 9)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items[2:], "item_id long, text string")
    for size in (8_000_000, 40):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in find_matches(docs, bench, slice_bytes=size).collect()}
        assert got == {i: brute(t, items[2:]) for i, t in rows}


def test_matches_are_longest(spark):
    q = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(["x", *q[3:20], "y", *q[0:12]]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(q))], "item_id long, text string")
    found = find_matches(docs, bench).first()["matches"]
    assert sorted((m["doc_word"], m["item_word"], m["words"]) for m in found) == [(1, 3, 17), (19, 0, 12)]


def test_edges(spark, edge, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "Two, WORDS!"), (None, "same row twice"), (4, "same row twice")], "item_id long, text string")
    rows = [(r[0], r[1]) for r in edge.select("doc_id", "text").collect()]
    key = lambda x: (x[0] or 0, x[1:])
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in find_matches(edge, bench).collect()]
    items = [tuple(r) for r in bench.collect()]
    assert sorted(got, key=key) == sorted([(i, *brute(t, items)) for i, t in rows if i != 7] + [g for g in got if g[0] == 7], key=key)
    assert find_matches(none, bench).count() == 0 and find_matches(edge, bench.limit(0)).agg({"n_hit": "max"}).first()[0] == 0
    kept = decontaminate(edge, bench)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, None, 7, 9, 10}
