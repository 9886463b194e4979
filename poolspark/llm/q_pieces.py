"""Query of operator 7."""

from pyspark.sql import functions as F

from poolspark.llm import pieces
from poolspark.llm.registry import documents, query


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op7_sentencepiece")
def op7_sentencepiece(spark, sf_dir):
    path = model_file()
    back = pieces.round_trip(documents(spark, sf_dir).select("doc_id", "text"), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))
