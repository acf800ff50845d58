"""Queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm.decontaminate import OP5_SQL, op5_decontamination
from tarnwick.llm.jaccard import OP7_SQL, op7_jaccard
from tarnwick.llm.langid import op2_langid
from tarnwick.llm.lattice import OP1_SQL, op1_lattice
from tarnwick.llm.mixing import op10_mixing
from tarnwick.llm.pii import op9_pii
from tarnwick.llm.secrets import OP8_SQL, op8_secrets
from tarnwick.llm.sharding import OP4_SQL, op4_sharding
from tarnwick.llm.suffix import OP3_SQL, op3_suffix
from tarnwick.llm.toxicity import op6_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lattice": op1_lattice,
        "op2_langid": op2_langid,
        "op3_suffix": op3_suffix,
        "op4_sharding": op4_sharding,
        "op5_decontamination": op5_decontamination,
        "op6_toxicity": op6_toxicity,
        "op7_jaccard": op7_jaccard,
        "op8_secrets": op8_secrets,
        "op9_pii": op9_pii,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_lattice": OP1_SQL,
        "op3_suffix": OP3_SQL,
        "op4_sharding": OP4_SQL,
        "op5_decontamination": OP5_SQL,
        "op7_jaccard": OP7_SQL,
        "op8_secrets": OP8_SQL,
    }
