"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from mnemosea.llm.alignment import op13_alignment
from mnemosea.llm.bpe import op4_bpe
from mnemosea.llm.filter_audit import SQL_OP12, op12_filter_audit
from mnemosea.llm.knn_join import SQL_OP2, op2_knn_join
from mnemosea.llm.langid import op3_langid
from mnemosea.llm.line_dedup import SQL_OP11, op11_line_dedup
from mnemosea.llm.lm_score import op9_lm_score
from mnemosea.llm.mixing import op1_pareto_mix
from mnemosea.llm.near_dup import op8_near_dup
from mnemosea.llm.token_output import op6_training_order
from mnemosea.llm.toxicity import op5_toxicity
from mnemosea.llm.warc import SQL_OP10, op10_warc
from mnemosea.llm.webp import op7_webp

QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_knn_join": op2_knn_join,
    "op3_langid": op3_langid,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_training_order": op6_training_order,
    "op7_webp": op7_webp,
    "op8_near_dup": op8_near_dup,
    "op9_lm_score": op9_lm_score,
    "op10_warc": op10_warc,
    "op11_line_dedup": op11_line_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_alignment": op13_alignment,
}

SQL: dict[str, str] = {
    "op2_knn_join": SQL_OP2,
    "op10_warc": SQL_OP10,
    "op11_line_dedup": SQL_OP11,
    "op12_filter_audit": SQL_OP12,
}
