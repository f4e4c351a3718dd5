"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from graphloom.llm.chat import OP11_SQL, op11_chat_format
from graphloom.llm.decontaminate import OP1_SQL, op1_decontaminate
from graphloom.llm.fill_middle import OP12_SQL, op12_fill_in_middle
from graphloom.llm.html_extract import op2_html_extract
from graphloom.llm.langid import op4_language_id
from graphloom.llm.line_dedup import OP8_SQL, op8_line_dedup
from graphloom.llm.media import op3_media_columns
from graphloom.llm.mixing import op10_mix_sources
from graphloom.llm.near_dup import OP7_SQL, op7_near_duplicates
from graphloom.llm.pii import op5_personal_data
from graphloom.llm.toxicity import op6_toxicity
from graphloom.llm.url_filter import OP9_SQL, op9_url_filter
from graphloom.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_html_extract": op2_html_extract,
    "op3_media_columns": op3_media_columns,
    "op4_language_id": op4_language_id,
    "op5_personal_data": op5_personal_data,
    "op6_toxicity": op6_toxicity,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_mix_sources": op10_mix_sources,
    "op11_chat_format": op11_chat_format,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_vector_codes": op13_vector_codes,
}

SQL = {
    "op1_decontaminate": OP1_SQL,
    "op7_near_duplicates": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_chat_format": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
