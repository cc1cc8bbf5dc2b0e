import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, row string, h long, n string, part int, token string, kept int, score double, __id string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (None, "a text without an id of its own"), (7, LONG),
    (8, "the same row twice over here"), (8, "the same row twice over here"), (9, "Ünï cödé 漢字 🙂 text 12"), (10, "<|endoftext|> and  double  spaces\n\n"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Null, empty, very long, repeated rows, and columns with clashing names, some of them null."""
    rows = [(i, t, "en" if i != 4 else None, "s", None, 1, "r", None, "n", 0, "t", None, 0.5, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return dict(docs.select("doc_id", "text").toPandas().itertuples(index=False))
