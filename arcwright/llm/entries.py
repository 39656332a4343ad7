"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from arcwright.llm.bpe import bpe_query
from arcwright.llm.chat import CHAT_SQL, chat_query
from arcwright.llm.exact_dedup import EXACT_DEDUP_SQL, exact_dedup_query
from arcwright.llm.lines import line_query
from arcwright.llm.lm import lm_query
from arcwright.llm.mixture import MIXTURE_SQL, mixture_query
from arcwright.llm.quality import QUALITY_SQL, quality_query
from arcwright.llm.simhash import simhash_query
from arcwright.llm.substring import substring_query
from arcwright.llm.warc import WARC_SQL, warc_query


def queries():
    return {
        "op1_exact_dedup": exact_dedup_query,
        "op2_bpe": bpe_query,
        "op3_lm_score": lm_query,
        "op4_simhash_near_dedup": simhash_query,
        "op5_substring_dedup": substring_query,
        "op6_line_dedup": line_query,
        "op7_chat_format": chat_query,
        "op8_source_mixture": mixture_query,
        "op9_quality_rules": quality_query,
        "op10_warc": warc_query,
    }


def oracle_sql():
    return {
        "op1_exact_dedup": EXACT_DEDUP_SQL,
        "op7_chat_format": CHAT_SQL,
        "op8_source_mixture": MIXTURE_SQL,
        "op9_quality_rules": QUALITY_SQL,
        "op10_warc": WARC_SQL,
    }
