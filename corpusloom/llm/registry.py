"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from corpusloom.llm import oracle
from corpusloom.llm.decontamination import op10_decontamination
from corpusloom.llm.licenses import op5_licenses
from corpusloom.llm.linededup import op2_line_dedup
from corpusloom.llm.packing import op1_packing
from corpusloom.llm.pii import op8_pii
from corpusloom.llm.quality import op3_quality
from corpusloom.llm.sharding import op9_sharding
from corpusloom.llm.simhash import op6_simhash
from corpusloom.llm.tokencount import op4_token_counts
from corpusloom.llm.toxicity import op7_toxicity

QUERIES = (op1_packing, op2_line_dedup, op3_quality, op4_token_counts, op5_licenses, op6_simhash, op7_toxicity, op8_pii, op9_sharding, op10_decontamination)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
