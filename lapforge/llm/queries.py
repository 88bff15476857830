"""All queries of the corpus operators, and the pipeline made of some of them."""

import corpus_pipeline
from lapforge.llm import (  # noqa: F401
    bpe, conversations, decontaminate, exact_dedup, licenses, quality, sharding, simhash, substrings, topk, urls, warc, whitening,
)
from lapforge.llm.registry import ORACLES, QUERIES, register

register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
