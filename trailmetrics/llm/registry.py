"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmetrics.llm.alignment import op11_fragment_monoid
from trailmetrics.llm.decontaminate import OP10_SQL, op10_winnowing
from trailmetrics.llm.lines import OP12_SQL, op12_levelled_runs
from trailmetrics.llm.lm import op7_backoff_automaton
from trailmetrics.llm.packing import op1_best_fit
from trailmetrics.llm.passages import op5_collinear_chains
from trailmetrics.llm.pii import op3_weak_supervision
from trailmetrics.llm.quality import op9_random_indexing
from trailmetrics.llm.ranking import OP13_SQL, op13_reversed_search
from trailmetrics.llm.sharding import op6_virtual_slots
from trailmetrics.llm.simhash import op4_vantage_simhash
from trailmetrics.llm.suffixes import op8_two_stage_suffixes
from trailmetrics.llm.topk import OP2_SQL, op2_threshold_top_k

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: list[Query] = [
    op1_best_fit,
    op2_threshold_top_k,
    op3_weak_supervision,
    op4_vantage_simhash,
    op5_collinear_chains,
    op6_virtual_slots,
    op7_backoff_automaton,
    op8_two_stage_suffixes,
    op9_random_indexing,
    op10_winnowing,
    op11_fragment_monoid,
    op12_levelled_runs,
    op13_reversed_search,
]


def llm_queries() -> dict[str, Query]:
    return {query.__name__: query for query in _QUERIES}


def llm_oracles() -> dict[str, str]:
    return {
        op2_threshold_top_k.__name__: OP2_SQL,
        op10_winnowing.__name__: OP10_SQL,
        op12_levelled_runs.__name__: OP12_SQL,
        op13_reversed_search.__name__: OP13_SQL,
    }
