"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from lexiloom.llm import decontamination, fingerprints, jaccard, language, licences, mixing, negatives, oracles, packing, planes, ranking, secrets, sharding, telephony

QUERIES = {
    "op1_telephony": telephony.op1_telephony,
    "op2_secrets": secrets.op2_secrets,
    "op3_language": language.op3_language,
    "op4_packing": packing.op4_packing,
    "op5_sharding": sharding.op5_shards,
    "op6_licences": licences.op6_licences,
    "op7_planes": planes.op7_planes,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_mixing": mixing.op9_mix,
    "op11_negatives": negatives.op11_negatives,
    "op12_decontamination": decontamination.op12_decontaminate,
    "op13_search": ranking.op13_search,
}


def oracle_sql() -> dict[str, str]:
    """SQL that gives the same rows. The others can't be SQL: vocabularies, random generators and hashes that DuckDB lacks;
    tests hold them against plain Python."""
    return {
        "op2_secrets": oracles.secrets_sql(),
        "op5_sharding": oracles.sharding_sql(),
        "op6_licences": oracles.licences_sql(),
        "op8_jaccard": oracles.jaccard_sql(),
        "op11_negatives": oracles.negatives_sql(),
        "op12_decontamination": oracles.decontamination_sql(),
        "op13_search": oracles.search_sql(),
    }
