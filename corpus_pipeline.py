"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.op1_language import keep_identified
from quillon.llm.op7_jaccard import keep_one
from quillon.llm.op8_packing import pack_documents
from quillon.llm.op9_substrings import drop_repeats
from quillon.llm.op10_secrets import redact_secrets
from quillon.session import table, written

#: (name, stage): each takes (spark, docs, sf_dir); all but the last return the columns of docs.
STAGES = [
    ("language", keep_identified),
    ("near_copies", keep_one),
    ("substrings", drop_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]

#: Profiles, automata and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
