"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.binary import op9_token_ids
from veilspark.llm.bpe import op4_bpe
from veilspark.llm.jaccard import ORACLE as JACCARD_SQL
from veilspark.llm.jaccard import op2_jaccard
from veilspark.llm.langid import op7_langid
from veilspark.llm.mixing import op5_mixing
from veilspark.llm.mjpeg import op10_avi_mjpeg
from veilspark.llm.quality import ORACLE as DIVERGENCE_SQL
from veilspark.llm.quality import op3_divergence
from veilspark.llm.sharding import op6_sharding
from veilspark.llm.toxicity import op8_toxicity
from veilspark.llm.urls import ORACLE as HOST_REPUTATION_SQL
from veilspark.llm.urls import op1_host_reputation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_reputation": op1_host_reputation,
    "op2_jaccard": op2_jaccard,
    "op3_divergence": op3_divergence,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_langid": op7_langid,
    "op8_toxicity": op8_toxicity,
    "op9_token_ids": op9_token_ids,
    "op10_avi_mjpeg": op10_avi_mjpeg,
}
ORACLES: dict[str, str] = {
    "op1_host_reputation": HOST_REPUTATION_SQL,
    "op2_jaccard": JACCARD_SQL,
    "op3_divergence": DIVERGENCE_SQL,
}
