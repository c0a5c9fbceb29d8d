"""Queries of this subpackage over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from .brown import op9_lm
from .decontaminate import op6_decontaminate
from .jaccard import op8_jaccard
from .language import op5_language
from .packing import op7_packing
from .quality import OP1_SQL, op1_quality
from .substrings import op2_lines
from .templates import op10_templates
from .urls import op4_urls
from .warc import op3_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_lines": op2_lines,
    "op3_warc": op3_warc,
    "op4_urls": op4_urls,
    "op5_language": op5_language,
    "op6_decontaminate": op6_decontaminate,
    "op7_packing": op7_packing,
    "op8_jaccard": op8_jaccard,
    "op9_lm": op9_lm,
    "op10_templates": op10_templates,
}
SQL = {"op1_quality": OP1_SQL}
