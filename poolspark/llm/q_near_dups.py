"""Query of operator 9."""

from poolspark.llm.near_dups import classes
from poolspark.llm.registry import documents, query


@query("op9_probminhash")
def op9_probminhash(spark, sf_dir):
    return classes(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
