"""op1: nearest neighbours of every twentieth embedding."""

from pyspark.sql import functions as F

from driftline.llm.ann import nearest
from driftline.llm.registry import query
from driftline.session import table


@query("op1_ann")
def op1_ann(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
