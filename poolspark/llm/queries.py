"""All queries of the subpackage; importing a module registers its own."""

from poolspark.llm import q_decontaminate, q_huffman, q_kneser_ney, q_langid, q_mixing, q_near_dups, q_pieces, q_resampling, q_scores, q_spotsigs, q_substrings, q_whitening  # noqa: F401
from poolspark.llm.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
