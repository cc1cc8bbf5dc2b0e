"""op13: quality of every document."""

from driftline.llm.quality import fit, score
from driftline.llm.registry import query
from driftline.llm.toxicity import remainder
from driftline.session import table


@query("op13_quality")
def op13_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
