"""Pipeline over ``documents``: toxicity, near-duplicates, repeated passages, benchmark passages, token ids.

Each stage is (name, function of (spark, docs, sf_dir)) and is judged on its own input; every stage but the last
returns the columns of ``documents``. ``run`` writes each stage's rows as Parquet to the shared folder and reads
them again, so a lost executor costs one stage at most. Rows whose id is null are never dropped as near-duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolspark.llm import decontaminate, near_dups, pieces, store, substrings, toxicity
from poolspark.llm.q_pieces import model_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below 0.7, learnt from all labels."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of texts that are alike to 0.8 or more."""
    return near_dups.deduplicate(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages of 35 words or more that stand elsewhere too; others unchanged."""
    out = substrings.dedup_substrings(docs)
    changed = F.col("n_removed") > 0
    return out.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it again."""
    out = pieces.round_trip(docs, model_file())
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.sha2("decoded", 256).alias("decoded_sha256"),
                      (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("substrings", cut_repeats),
          ("decontamination", drop_contaminated), ("sentencepiece", to_ids)]

#: Learnt scores and token ids cannot be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = store.shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
    return docs
