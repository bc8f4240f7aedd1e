"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from stridelake.llm.bpe import op4_bpe
from stridelake.llm.cover_tree import op3_cover_tree
from stridelake.llm.langid import op6_langid
from stridelake.llm.line_rules import ORACLE_SQL as LINE_RULES_SQL
from stridelake.llm.line_rules import op8_line_rules
from stridelake.llm.merkle import ORACLE_SQL as MERKLE_SQL
from stridelake.llm.merkle import op11_merkle
from stridelake.llm.packing import op7_packing
from stridelake.llm.periodic import op13_periodic
from stridelake.llm.quality_eb import op9_quality_eb
from stridelake.llm.simhash import op10_simhash
from stridelake.llm.suffix_dedup import op1_suffix_dedup
from stridelake.llm.surrogates import op5_surrogates
from stridelake.llm.warc import op2_warc
from stridelake.llm.winnowing import op12_winnowing


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_warc": op2_warc,
        "op3_cover_tree": op3_cover_tree,
        "op4_bpe": op4_bpe,
        "op5_surrogates": op5_surrogates,
        "op6_langid": op6_langid,
        "op7_packing": op7_packing,
        "op8_line_rules": op8_line_rules,
        "op9_quality_eb": op9_quality_eb,
        "op10_simhash": op10_simhash,
        "op11_merkle": op11_merkle,
        "op12_winnowing": op12_winnowing,
        "op13_periodic": op13_periodic,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_line_rules": LINE_RULES_SQL, "op11_merkle": MERKLE_SQL}
