"""Query of operator 2."""

from poolspark.llm.decontaminate import matches
from poolspark.llm.registry import documents, query


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
