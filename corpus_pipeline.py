"""The document pipeline: from raw documents to packed training sequences.

Each stage gets all rows that the one before it kept, as a table in the shared folder. A lost executor costs the tasks
of one stage.
"""

from __future__ import annotations

import functools

from clearwell.llm.common import BATCH_ROWS
from clearwell.llm.exact import deduplicate
from clearwell.llm.jaccard import drop_near_duplicates
from clearwell.llm.packing import pieces_of
from clearwell.llm.rules import reject
from clearwell.llm.secrets import redact
from clearwell.session import configure, materialize, name_local_folder


def stage(fn):
    """A stage may also be run by itself, in a session as it comes."""

    @functools.wraps(fn)
    def run_stage(spark, docs, sf_dir):
        name_local_folder(spark)
        configure(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return fn(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and are no outliers of their language and source."""
    return reject(docs)


@stage
def exact_dedup(spark, docs, sf_dir):
    """One document of each text."""
    return deduplicate(docs)


@stage
def near_dedup(spark, docs, sf_dir):
    """One document of each component of near duplicates: five words, a similarity of 0.8 or more."""
    return drop_near_duplicates(docs)


@stage
def secret_scan(spark, docs, sf_dir):
    """All documents, secrets replaced by a marker, ``n_chars`` as the text then is."""
    return redact(docs)


@stage
def packing(spark, docs, sf_dir):
    """Pieces of sequences of 2048 tokens."""
    return pieces_of(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]
#: Tokens of a byte-level vocabulary can't be had in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, each written and read again but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name_local_folder(spark)
    for _, step in STAGES[:-1]:
        docs = materialize(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
