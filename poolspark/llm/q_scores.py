"""Queries of operators 4 and 8."""

from pyspark.sql import functions as F

from poolspark.llm import ordinal, toxicity
from poolspark.llm.q_kneser_ney import remainder
from poolspark.llm.registry import documents, query


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(True))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "score", "predicted")


@query("op8_ordinal_quality")
def op8_ordinal_quality(spark, sf_dir):
    """Grades: 0 for quality 0, 1 for good but toxic, 2 for good; kept is what is likelier good than not."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.coalesce(remainder("doc_id", 4) == 1, F.lit(True))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held)
    model = ordinal.fit(docs, labels, F.col("quality") * (2 - F.col("toxic")), grades=3)
    out = ordinal.score(docs.withColumn("held_out", held), model)
    return out.select("doc_id", "held_out", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("keep"))
