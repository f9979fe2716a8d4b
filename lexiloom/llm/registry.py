"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from lexiloom.llm import (
    bpe,
    chat_format,
    decontaminate,
    exact_dedup,
    hard_negatives,
    heap_lloyd,
    hilbert_shards,
    license_scan,
    simhash,
    suffix_dedup,
    toxicity,
    url_filter,
    warc,
)

MODULES = (url_filter, bpe, exact_dedup, decontaminate, toxicity, chat_format, hilbert_shards, warc, simhash, license_scan, suffix_dedup, heap_lloyd, hard_negatives)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
