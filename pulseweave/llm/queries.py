"""All queries of the subpackage; importing the operators registers them."""

from __future__ import annotations

import corpus_pipeline
from pulseweave.llm import (  # noqa: F401
    ann, chat, idfiles, langid, lexical, minhash, mixing, pieces, sharding, toxicity, trie, vectors, warc,
)
from pulseweave.llm.common import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
