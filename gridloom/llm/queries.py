"""Queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import chat, mixing, url_filter, warc
from .decontaminate import op4_query
from .jaccard_join import op9_query
from .kneser_ney import op1_query
from .language_id import op2_query
from .suffix_dedup import op7_query
from .winnow import op5_query

QUERIES = {
    "op1_kneser_ney": op1_query,
    "op2_language_id": op2_query,
    "op3_warc": warc.op3_query,
    "op4_decontaminate": op4_query,
    "op5_winnow": op5_query,
    "op6_perspectives": chat.op6_query,
    "op7_suffix_dedup": op7_query,
    "op8_url_filter": url_filter.op8_query,
    "op9_jaccard_join": op9_query,
    "op10_mixing": mixing.op10_query,
    "url_rules": url_filter.rules_query,
}
SQL: dict[str, str] = {
    "op3_warc": warc.SQL,
    "op6_perspectives": chat.SQL,
    "op10_mixing": mixing.SQL,
    "url_rules": url_filter.SQL,
}
