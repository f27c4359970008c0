"""A bounded sample of labelled documents, to fit a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import texts


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, where: Column | None = None) -> DataFrame:
    """``text`` and ``label`` of at most ``rows`` labelled documents, those whose ids have the smallest hashes.

    ``where`` is a condition on doc_id. Rows without id or label are no labels; of several labels for an id the largest
    counts. The sample is what may be broadcast: ``rows`` ids and numbers.
    """
    named = labels.select("doc_id", F.col(column).alias("label")).where("doc_id is not null and label is not null")
    if where is not None:
        named = named.where(where)
    named = named.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    few = materialize(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return texts(docs).join(F.broadcast(few), "doc_id").select("text", "label")
