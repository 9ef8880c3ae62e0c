"""Queries of this subpackage, by the names that the driver knows. Where SQL cannot state one, tests/llm
holds it against a brute-force version, an exact round trip or held-out accuracy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, hard_negatives, pivots
from .chat import op5_chat
from .decontam import op7_decontam
from .filter_audit import op13_filter_audit
from .gif import op3_gif
from .hard_negatives import op11_hard_negatives
from .langid import op9_langid
from .neardup import op2_neardup
from .packing import op1_pack
from .pii import op10_pii
from .pivots import op12_pivot_neardup
from .rans import op8_tokens
from .scoring import op6_ctw
from .substrings import op4_repeats


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack, op2_neardup, op3_gif, op4_repeats, op5_chat, op6_ctw, op7_decontam, op8_tokens, op9_langid, op10_pii, op11_hard_negatives, op12_pivot_neardup, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": hard_negatives.SQL, "op12_pivot_neardup": pivots.SQL, "op13_filter_audit": filter_audit.SQL}
