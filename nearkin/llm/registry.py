"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearkin.llm.context_trees import op8_context_tree_weighting
from nearkin.llm.conversation_trie import OP13_SQL, op13_conversation_trie
from nearkin.llm.decontaminate import op1_decontamination
from nearkin.llm.log_templates import OP3_SQL, op3_log_templates
from nearkin.llm.multi_index import op11_multi_index
from nearkin.llm.pieces import op5_piece_suffix_arrays
from nearkin.llm.pivots import OP4_SQL, op4_pivot_permutations
from nearkin.llm.repeats import op7_suffix_array_family
from nearkin.llm.simhash import op10_simhash_near_dedup
from nearkin.llm.token_shards import op9_token_shards
from nearkin.llm.toxicity import op6_toxicity
from nearkin.llm.url_lists import OP2_SQL, op2_url_lists
from nearkin.llm.word_runs import op12_word_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_url_lists,
        op3_log_templates,
        op4_pivot_permutations,
        op5_piece_suffix_arrays,
        op6_toxicity,
        op7_suffix_array_family,
        op8_context_tree_weighting,
        op9_token_shards,
        op10_simhash_near_dedup,
        op11_multi_index,
        op12_word_runs,
        op13_conversation_trie,
    )
}

ORACLES: dict[str, str] = {
    op2_url_lists.__name__: OP2_SQL,
    op3_log_templates.__name__: OP3_SQL,
    op4_pivot_permutations.__name__: OP4_SQL,
    op13_conversation_trie.__name__: OP13_SQL,
}
