import random
import re

from driftline.llm.pii import find, listed, luhn
from pyspark.sql import functions as F

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def is_luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 13 <= len(d) <= 19 and is_luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m[0]))


def base(docs):
    return [(r[0], r[1]) for r in find(docs).select("doc_id", listed(F.col("base"))).collect()]


def test_documents(docs, texts):
    assert dict(base(docs)) == {i: brute(t) for i, t in texts.items()}


def test_random_texts(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["1", "4", "0", "25", "5", ".", ".", "@", "a", "b-", "+", " ", "-", "é", "🙂", "_", "(", "4111 1111 1111 1111", "1.2.3.4", "\n"]) for _ in range(60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert dict(base(docs)) == {i: brute(t) for i, t in rows}


def test_luhn(spark):
    rows = [("4111111111111111",), ("4111111111111112",), ("79927398713",), ("0",)]
    got = spark.createDataFrame(rows, "d string").select("d", luhn(F.col("d"))).collect()
    assert {r[0]: r[1] for r in got} == {d: is_luhn(d) for (d,) in rows}


def test_contexts_find_more(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, f"{rng.choice(words)} write mailto user{i}@host{i}.example.org {rng.choice(words)} {rng.choice(words)}") for i in range(30)]
    rows += [(100, "please mailto someone9@localhost now"), (101, "the year 2020 and someone8@localhost and 12 more"), (102, "nothing here")]
    got = {r["doc_id"]: r["added"] for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["value"]) for s in got[100]] == [("near_email", "someone9@localhost")]
    assert all(not v for k, v in got.items() if k != 100)


def test_edges(edge, none):
    pairs = [(r[0], r[1]) for r in edge.select("doc_id", "text").collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(base(edge), key=key) == sorted([(i, brute(t)) for i, t in pairs], key=key)
    assert find(none).count() == 0


def test_long_runs(spark):
    rows = [(1, "1" * 50000), (2, "1 " * 50000), (3, "a" * 50000 + "@"), (4, "+1" + "." * 50000), (5, "1." * 30000)]
    assert dict(base(spark.createDataFrame(rows, "doc_id long, text string"))) == {i: brute(t) for i, t in rows}
