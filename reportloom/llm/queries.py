"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op9_bpe
from .chat import op5_chat
from .fingerprints import op4_fingerprints
from .html import op2_html
from .jaccard import op10_jaccard
from .language import op1_language
from .media import op8_media
from .mixing import OP6_SQL, op6_mixing
from .repair import OP13_SQL, op13_repair
from .secrets import op7_secrets
from .tokenfiles import op12_orc_tokens
from .toxicity import op3_toxicity
from .vectorcodes import OP11_SQL, op11_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language,
        "op2_html": op2_html,
        "op3_toxicity": op3_toxicity,
        "op4_fingerprints": op4_fingerprints,
        "op5_chat": op5_chat,
        "op6_mixing": op6_mixing,
        "op7_secrets": op7_secrets,
        "op8_media": op8_media,
        "op9_bpe": op9_bpe,
        "op10_jaccard": op10_jaccard,
        "op11_vector_codes": op11_vector_codes,
        "op12_orc_tokens": op12_orc_tokens,
        "op13_repair": op13_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mixing": OP6_SQL,
        "op11_vector_codes": OP11_SQL,
        "op13_repair": OP13_SQL,
    }
