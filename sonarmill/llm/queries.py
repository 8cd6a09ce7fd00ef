"""The registered queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from sonarmill.llm.decontaminate import op8_decontaminate
from sonarmill.llm.html_text import op1_main_text
from sonarmill.llm.language import op2_language
from sonarmill.llm.mixing import op6_mixing
from sonarmill.llm.near_dup import OP10_SQL, op10_near_dup
from sonarmill.llm.pii import op9_pii
from sonarmill.llm.quality import op7_quality
from sonarmill.llm.repeats import op3_repeats
from sonarmill.llm.toxicity import op4_toxicity
from sonarmill.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_language": op2_language,
    "op3_repeats": op3_repeats,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_pii": op9_pii,
    "op10_near_dup": op10_near_dup,
}

ORACLE_SQL: dict[str, str] = {"op5_warc": OP5_SQL, "op10_near_dup": OP10_SQL}
