"""The operators' registered queries and oracle SQL."""

from tablelens.llm import (ann, ctw, decontaminate, encode, hnsw, mixing, negatives, simhash, substring, tokens, toxicity, warc,  # noqa: F401
                           whiten)
from tablelens.llm.common import ORACLE, QUERIES  # noqa: F401
