"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from .chat import OP6_SQL, op6_chat_format
from .collocations import op13_collocations
from .decontaminate import op4_decontaminate
from .html import op1_html_text
from .langid import op3_langid
from .packing import op11_packing
from .quality import op2_quality
from .repeats import op8_repeats
from .rules import OP10_SQL, op10_quality_rules
from .secret_scan import op9_secret_scan
from .sentencepiece import op5_sentencepiece
from .simhash import op7_simhash
from .spelling import op12_spelling

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_quality": op2_quality,
    "op3_langid": op3_langid,
    "op4_decontaminate": op4_decontaminate,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_chat_format": op6_chat_format,
    "op7_simhash": op7_simhash,
    "op8_repeats": op8_repeats,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_packing": op11_packing,
    "op12_spelling": op12_spelling,
    "op13_collocations": op13_collocations,
}

#: DuckDB twins where SQL can express a query.
ORACLE: dict[str, str] = {
    "op6_chat_format": OP6_SQL,
    "op10_quality_rules": OP10_SQL,
}
