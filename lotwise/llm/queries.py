"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from lotwise.llm.byte_bpe import op6_byte_bpe
from lotwise.llm.chat import op9_chat_format
from lotwise.llm.conversation_repair import op12_conversation_repair
from lotwise.llm.decontaminate import op4_decontaminate
from lotwise.llm.fill_in_middle import op13_fill_in_middle
from lotwise.llm.html_extract import op5_html_extract
from lotwise.llm.jaccard_join import op8_jaccard_join
from lotwise.llm.oracles import SQL
from lotwise.llm.quality_classifier import op2_quality_classifier
from lotwise.llm.quality_rules import op1_quality_rules
from lotwise.llm.simhash import op11_simhash
from lotwise.llm.token_counts import op7_token_counts
from lotwise.llm.url_filter import op10_url_filter
from lotwise.llm.warc import op3_warc

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_warc, op4_decontaminate, op5_html_extract, op6_byte_bpe, op7_token_counts,
    op8_jaccard_join, op9_chat_format, op10_url_filter, op11_simhash, op12_conversation_repair, op13_fill_in_middle)}

__all__ = ["QUERIES", "SQL"]
