"""op11: two tokenizers' ids of every document, aligned."""

from driftline.llm.alignment import align
from driftline.llm.registry import query
from driftline.session import table


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"))
