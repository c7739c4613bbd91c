"""The queries of this subpackage, with production parameters, and their SQL where there is any."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

for _name in ("chat", "simhash", "bpe", "ann", "packing", "tokenfile", "quality", "ngram", "pii", "matroska"):
    _m = importlib.import_module(f"tidemark.llm.queries_{_name}")
    QUERIES |= _m.QUERIES
    ORACLE |= getattr(_m, "ORACLE", {})
