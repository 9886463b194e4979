"""Query of operator 10."""

from pyspark.sql import functions as F

from poolspark.llm import langid
from poolspark.llm.q_kneser_ney import remainder
from poolspark.llm.registry import documents, query


@query("op10_crf_language")
def op10_crf_language(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(True))
    model = langid.fit(docs.where(~held).select("doc_id", "text", "lang"))
    return langid.label(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
