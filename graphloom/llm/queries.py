"""Registered queries of the operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

from corpus_pipeline import ORACLE_SQL as PIPELINE_ORACLE
from corpus_pipeline import run as pipeline
from graphloom.llm.byte_bpe import op9_byte_bpe
from graphloom.llm.chat import ORACLE as CHAT_ORACLE
from graphloom.llm.chat import op7_chat
from graphloom.llm.ivf_pq import op4_ivf_pq
from graphloom.llm.lattice_lm import op6_lattice_lm
from graphloom.llm.mixing import ORACLE as MIXING_ORACLE
from graphloom.llm.mixing import op10_mixing
from graphloom.llm.quality_classifier import op1_quality_classifier
from graphloom.llm.quality_rules import ORACLE as RULES_ORACLE
from graphloom.llm.quality_rules import op5_quality_rules
from graphloom.llm.simhash import op8_simhash
from graphloom.llm.suffix_dedup import ORACLE as REPEATS_ORACLE
from graphloom.llm.suffix_dedup import op3_suffix_dedup
from graphloom.llm.wavelet import op2_wavelet

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_wavelet": op2_wavelet,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ivf_pq": op4_ivf_pq,
    "op5_quality_rules": op5_quality_rules,
    "op6_lattice_lm": op6_lattice_lm,
    "op7_chat": op7_chat,
    "op8_simhash": op8_simhash,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_mixing": op10_mixing,
    "pipeline": pipeline,
}
ORACLES = {"op3_suffix_dedup": REPEATS_ORACLE, "op5_quality_rules": RULES_ORACLE, "op7_chat": CHAT_ORACLE, "op10_mixing": MIXING_ORACLE} | ({"pipeline": PIPELINE_ORACLE} if PIPELINE_ORACLE else {})
