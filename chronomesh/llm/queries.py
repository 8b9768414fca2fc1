"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from chronomesh.llm import mixing, topk
from chronomesh.llm.lines import op4_line_dedup
from chronomesh.llm.mixing import op2_mixing
from chronomesh.llm.packing import op10_packing
from chronomesh.llm.passages import op9_passages
from chronomesh.llm.periods import op11_periodic_runs
from chronomesh.llm.quality import op3_quality_rules
from chronomesh.llm.secrets import op6_secret_scans
from chronomesh.llm.simhash import op7_simhash
from chronomesh.llm.suffixes import op12_suffix_array
from chronomesh.llm.topk import op8_topk_search
from chronomesh.llm.toxicity import op1_toxicity
from chronomesh.llm.urls import op5_url_filters
from chronomesh.llm.whitening import op13_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_secret_scans": op6_secret_scans,
    "op7_simhash": op7_simhash,
    "op8_topk_search": op8_topk_search,
    "op9_passages": op9_passages,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_suffix_array": op12_suffix_array,
    "op13_whitening": op13_whitening,
}

#: The others use trained weights, hashes or a tokenizer that SQL doesn't have; tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op8_topk_search": topk.ORACLE}
