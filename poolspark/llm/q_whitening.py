"""Query of operator 12."""

from pyspark.sql import functions as F

from poolspark.llm.registry import query
from poolspark.llm.whitening import whiten


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(vectors.select("vec_id", F.col("embedding").alias("vec")))
