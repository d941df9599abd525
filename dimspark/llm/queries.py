"""The corpus queries, each over its whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dimspark.llm.licenses import op8_license_scans
from dimspark.llm.linededup import OP3_SQL, op3_line_dedup
from dimspark.llm.media import op7_media_columns
from dimspark.llm.mixing import op4_mixing
from dimspark.llm.ngram_join import op6_ngram_jaccard_join
from dimspark.llm.packing import op1_packing
from dimspark.llm.quality import op2_quality_rules
from dimspark.llm.secrets import op5_secret_scans
from dimspark.llm.sharding import op10_sharding
from dimspark.llm.toxicity import op9_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_quality_rules": op2_quality_rules,
        "op3_line_dedup": op3_line_dedup,
        "op4_mixing": op4_mixing,
        "op5_secret_scans": op5_secret_scans,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_media_columns": op7_media_columns,
        "op8_license_scans": op8_license_scans,
        "op9_toxicity": op9_toxicity,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL}
