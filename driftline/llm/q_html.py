"""op5: main text of every page."""

from pyspark.sql import functions as F

from driftline.llm.html_text import extract_text, fit
from driftline.llm.registry import query
from driftline.session import table


@query("op5_html_text")
def op5_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit(pages)).withColumn("n_chars", F.char_length("text").cast("long"))
