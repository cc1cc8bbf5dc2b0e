"""op3: every document packed into sequences of 1024 tokens."""

from pyspark.sql import functions as F

from driftline.llm.packing import pack
from driftline.llm.registry import query
from driftline.session import table


@query("op3_packing")
def op3_packing(spark, sf_dir):
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
