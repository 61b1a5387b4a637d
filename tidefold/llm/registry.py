"""Queries of the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidefold.llm.chat import op4_chat
from tidefold.llm.decontaminate import op10_decontaminate
from tidefold.llm.html import op2_html
from tidefold.llm.lines import OP9_SQL, op9_lines
from tidefold.llm.negatives import OP13_SQL, op13_negatives
from tidefold.llm.packing import op3_packing
from tidefold.llm.quality import op7_quality
from tidefold.llm.sharding import op11_sharding
from tidefold.llm.simhash import op6_simhash
from tidefold.llm.substring import op5_substring
from tidefold.llm.toxicity import op1_toxicity
from tidefold.llm.warc import OP8_SQL, op8_warc
from tidefold.llm.whitening import op12_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_html": op2_html,
        "op3_packing": op3_packing,
        "op4_chat": op4_chat,
        "op5_substring": op5_substring,
        "op6_simhash": op6_simhash,
        "op7_quality": op7_quality,
        "op8_warc": op8_warc,
        "op9_lines": op9_lines,
        "op10_decontaminate": op10_decontaminate,
        "op11_sharding": op11_sharding,
        "op12_whitening": op12_whitening,
        "op13_negatives": op13_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": OP8_SQL, "op9_lines": OP9_SQL, "op13_negatives": OP13_SQL}
