"""Query of operator 6."""

from pyspark.sql import functions as F

from poolspark.llm import huffman, store
from poolspark.llm.registry import documents, query


@query("op6_huffman_ids")
def op6_huffman_ids(spark, sf_dir):
    import public_tokenizers

    folder = store.shared_folder(spark, "huffman")
    huffman.write(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return huffman.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
