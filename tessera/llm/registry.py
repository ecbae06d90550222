"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tessera.llm import (collocations, decontam, idfiles, langid, packing, pii, quality, resample, sentences, simhash,
                         suffixtree, toxicity, urlfilter)

MODULES = [langid, packing, pii, quality, decontam, sentences, idfiles, simhash, toxicity, suffixtree, collocations, urlfilter, resample]


def all_queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
