from driftline.llm.language import BLOCK, fit, held_out, phrases, plain, predict


def brute(text, corpora):
    """Phrases per language: the longest run that occurs in the training text, block by block; a strange symbol is two."""
    out = []
    for corpus in corpora:
        n = 0
        for b in range(0, len(text), BLOCK):
            part, i = text[b : b + BLOCK], 0
            while i < len(part):
                j = i + 1
                while j <= len(part) and part[i:j] in corpus:
                    j += 1
                n += 1 if part[i] in corpus else 2
                i = max(i + 1, j - 1)
        out.append(n)
    return out


def test_phrases_are_longest_matches(spark):
    rows = [("en", "the cat sat on the mat and the dog"), ("fr", "le chat est sur la table et le chien")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = fit(docs)
    corpora = [plain(t) + " " for _, t in rows]
    texts = [plain(t) for t in ("the dog and the cat", "la table du chien", "xyzzy qqq", "", "the " * 200, "a", "Ωmega the")]
    assert phrases(model, texts).tolist() == [brute(t, corpora) for t in texts]


def test_held_out_accuracy(docs):
    got = predict(docs, fit(docs, sample=~held_out())).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_edges(edge, none, docs):
    model = fit(docs)
    got = [(r["doc_id"], r["lang_pred"]) for r in predict(edge, model).collect()]
    assert len(got) == edge.count()
    assert {i for i, l in got if l == "und"} == {1, 2, 3}
    assert predict(none, model).count() == 0
    assert {r["lang_pred"] for r in predict(edge, fit(none)).collect()} == {"und"}


def _accuracy(spark, make, languages=("aa", "bb"), n=300, seed=1):
    import random

    rng = random.Random(seed)
    rows = [(i, lang := rng.choice(languages), make(rng, lang)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = fit(docs.where("doc_id % 3 <> 0"))
    got = {r["doc_id"]: r["lang_pred"] for r in predict(docs.where("doc_id % 3 = 0"), model).collect()}
    return sum(got[i] == lang for i, lang, _ in rows if i % 3 == 0) / len(got)


def test_alphabets_of_thousands_of_characters(spark):
    alphabet = {"aa": [chr(0x4E00 + i) for i in range(3000)], "bb": [chr(0x4E00 + 3000 + i) for i in range(3000)]}
    assert _accuracy(spark, lambda rng, k: "".join(rng.choices(alphabet[k], k=80))) >= 0.95


def test_a_shared_header_teaches_nothing(spark):
    import random

    rng = random.Random(3)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 8)))
    words = {"aa": [word("abcdefghij") for _ in range(200)], "bb": [word("efghijklmn") for _ in range(200)]}
    header = " ".join(word("opqrstuvwxyz") for _ in range(110))[:600]
    assert _accuracy(spark, lambda r, k: header + " " + " ".join(r.choices(words[k], k=60))) >= 0.95


def test_hash_table_of_transitions():
    import numpy as np

    from driftline.llm.language import Model, hashed

    keys = np.unique(np.random.default_rng(1).integers(0, 5000, 2000))
    slots, targets = hashed(keys, keys * 7)
    model = Model([], np.arange(9), slots, targets, np.zeros(0), np.zeros(0))  # ten symbols with the unknown one
    every = np.arange(6000)
    want = np.where(np.isin(every, keys), every * 7, -1)
    assert (model.step(every // 10, every % 10) == want).all()
