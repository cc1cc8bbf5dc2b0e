"""Every stage against a plain version over its own input."""

import corpus_pipeline
import pytest

from driftline.llm.decontamination import find_matches
from driftline.llm.ngram_join import near_groups
from driftline.llm.toxicity import fit, score


@pytest.fixture(scope="module")
def steps(spark, sf, docs):
    from driftline.session import materialize

    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, materialize(stage(spark, out[-1][1], sf), "test-stage")))
    return dict(out)


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]


def test_stages(spark, sf, steps):
    docs = steps["documents"]
    for name in ("toxicity", "line_dedup", "ngram_join", "decontamination"):
        assert steps[name].columns == docs.columns
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in steps.items()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r["doc_id"] for r in score(docs, fit(docs, labels)).where("predicted = 1").collect()}
    assert ids["toxicity"] == ids["documents"] - toxic
    groups = near_groups(steps["line_dedup"], rule=corpus_pipeline.NEAR).collect()
    assert ids["ngram_join"] == {r["component_id"] for r in groups}
    found = find_matches(steps["ngram_join"], spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert ids["decontamination"] == {r["doc_id"] for r in found.where("n_hit = 0").collect()}
    assert ids["packing"] == ids["decontamination"]


def test_lines_are_unique_after_dedup(steps):
    rows = steps["line_dedup"].select("text", "n_chars").collect()
    lines = [line for r in rows for line in r["text"].split("\n") if line.strip(" ")]
    assert len(lines) == len(set(lines)) and all(len(r["text"]) == r["n_chars"] for r in rows)
    before = {line for r in steps["toxicity"].select("text").collect() for line in r["text"].split("\n")}
    assert set(lines) <= before


def test_run_is_the_stages(spark, sf, steps):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == steps["packing"].columns
    total = "sum(length)"
    assert got.selectExpr(total).first()[0] == steps["packing"].selectExpr(total).first()[0]


def test_odd_documents(spark, sf, edge, none):
    for rows in (edge, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            if name != "packing":
                assert out.columns == rows.columns
            out.count()
