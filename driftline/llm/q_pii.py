"""op4: personal data in every document."""

from pyspark.sql import functions as F

from driftline.llm.pii import KINDS, find, listed
from driftline.llm.registry import query
from driftline.session import table


def _of(kind):
    return lambda s: s["kind"] == kind


@query("op4_pii")
def op4_pii(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
