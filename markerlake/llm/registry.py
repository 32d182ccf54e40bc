"""Queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP9_SQL, op9_decontamination
from .embedding_dedup import op7_embedding_dedup
from .language_id import op6_language_id
from .line_dedup import OP1_SQL, op1_line_dedup
from .near_dedup import op4_near_dedup
from .pii import op10_pii
from .planes import op5_token_planes
from .quality import op3_quality
from .shared import table
from .url_filter import OP8_SQL, op8_url_filter


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file, the same on driver and executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict:
    return {"op1_line_dedup": op1_line_dedup, "op2_bpe": op2_bpe, "op3_quality": op3_quality, "op4_near_dedup": op4_near_dedup, "op5_token_planes": op5_token_planes, "op6_language_id": op6_language_id, "op7_embedding_dedup": op7_embedding_dedup, "op8_url_filter": op8_url_filter, "op9_decontamination": op9_decontamination, "op10_pii": op10_pii}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op8_url_filter": OP8_SQL, "op9_decontamination": OP9_SQL}
