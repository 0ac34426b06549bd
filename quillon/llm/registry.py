"""Queries of the corpus operators and their SQL oracles."""

from __future__ import annotations

from quillon.llm import decontaminate, langid, language_model, neighbours, packing, pseudonyms, secrets, sharding, simhash, toxicity

_QUERIES = {
    "op1_sharding": sharding.query,
    "op2_packing": packing.query,
    "op3_lm_scoring": language_model.query,
    "op4_secrets": secrets.query,
    "op5_decontamination": decontaminate.query,
    "op6_pseudonyms": pseudonyms.query,
    "op7_langid": langid.query,
    "op8_neighbours": neighbours.query,
    "op9_simhash": simhash.query,
    "op10_toxicity": toxicity.query,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontaminate.ORACLE_SQL}
