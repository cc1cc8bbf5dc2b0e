"""op8: toxicity of every document."""

from pyspark.sql import functions as F

from driftline.llm.registry import query
from driftline.llm.toxicity import fit, remainder, score
from driftline.session import table


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
