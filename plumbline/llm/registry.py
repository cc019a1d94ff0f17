"""The training-data queries and the SQL that checks them."""

from plumbline.llm.chat import SQL_OP2, op2_chat_perspectives
from plumbline.llm.decontaminate import SQL_OP1, op1_decontaminate
from plumbline.llm.html_text import op3_main_text
from plumbline.llm.mixing import op6_mix_sources
from plumbline.llm.simhash import op5_simhash
from plumbline.llm.substrings import op7_repeated_passages
from plumbline.llm.token_counts import SQL_OP4, op4_token_counts, token_counts_by_vocabulary
from plumbline.llm.token_output import op9_training_order
from plumbline.llm.top_k import SQL_OP10, op10_exact_top_k
from plumbline.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat_perspectives": op2_chat_perspectives,
    "op3_main_text": op3_main_text,
    "op4_token_counts": op4_token_counts,
    "op5_simhash": op5_simhash,
    "op6_mix_sources": op6_mix_sources,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_toxicity": op8_toxicity,
    "op9_training_order": op9_training_order,
    "op10_exact_top_k": op10_exact_top_k,
    "token_counts_by_vocabulary": token_counts_by_vocabulary,
}
ORACLE_SQL = {"op1_decontaminate": SQL_OP1, "op2_chat_perspectives": SQL_OP2, "op4_token_counts": SQL_OP4, "op10_exact_top_k": SQL_OP10}
