"""Query of operator 3."""

from pyspark.sql import functions as F

from poolspark.llm import spotsigs
from poolspark.llm.registry import documents, query


@query("op3_spotsigs")
def op3_spotsigs(spark, sf_dir):
    out = spotsigs.compare_edited(documents(spark, sf_dir))
    own, edited, after = F.col("print"), F.col("edited_print"), F.col("next_print")
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spotsigs.as_text(own).alias("fingerprint"),
                      spotsigs.as_text(edited).alias("edited_fingerprint"), spotsigs.likeness(own, edited).alias("near_edited"),
                      spotsigs.likeness(own, after).alias("near_next"))
