"""op9: language of every document."""

from driftline.llm.language import fit, held_out, predict
from driftline.llm.registry import query
from driftline.session import table


@query("op9_language")
def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, sample=~held_out())
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
