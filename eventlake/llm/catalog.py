"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP2_SQL, op2_chat_format
from .decontaminate import OP8_SQL, op8_decontaminate
from .near_dedup import OP9_SQL, op9_near_dedup
from .neighbours import OP11_SQL, op11_nearest_neighbours
from .phrases import OP13_SQL, op13_collocations
from .pieces import op10_sentencepiece
from .quality import op4_quality_rules
from .secrets import op5_secret_scan
from .sharding import op7_sharding
from .suffixes import op1_suffix_dedup
from .spelling import OP12_SQL, op12_spelling_variants
from .substrings import OP3_SQL, op3_substring_dedup
from .url_filter import op6_url_filter

QUERIES = [op1_suffix_dedup, op2_chat_format, op3_substring_dedup, op4_quality_rules, op5_secret_scan, op6_url_filter, op7_sharding, op8_decontaminate, op9_near_dedup, op10_sentencepiece, op11_nearest_neighbours, op12_spelling_variants, op13_collocations]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op8_decontaminate": OP8_SQL, "op9_near_dedup": OP9_SQL, "op11_nearest_neighbours": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_collocations": OP13_SQL}
