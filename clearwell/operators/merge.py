"""Upsert of one table into another."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import col
from .dedup import remove_duplicates


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """The target with every incoming row in place of the rows that share its key.

    Of several incoming rows with one key the last in ``order_by`` order wins (without it the largest row). A
    row with a null in its key matches nothing and is always added. Columns the incoming table lacks become
    null in new rows; columns the target lacks are refused.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keys:
        raise ValueError("upsert needs key columns")
    unknown = [c for c in incoming.columns if c not in target.columns]
    if unknown:
        raise ValueError(f"columns {unknown} are not in the target table")
    absent = [k for k in keys if k not in incoming.columns]
    if absent:
        raise ValueError(f"key columns {absent} are not in the incoming table")
    whole_key = functools.reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys])
    keyed = incoming.filter(whole_key)
    order = list(order_by or [c for c in incoming.columns if c not in keys])
    if order:
        keyed = remove_duplicates(keyed, {"subset": keys, "keep": "last", "order_by": order})
    else:
        keyed = keyed.dropDuplicates()
    kept = target.join(keyed.select(*[col(k) for k in keys]), keys, "left_anti")
    added = keyed.unionByName(incoming.filter(~whole_key))
    update_types = {f.name: f.dataType for f in target.schema.fields}
    added = added.select(
        *[
            col(c).cast(update_types[c]).alias(c) if c in added.columns else F.lit(None).cast(update_types[c]).alias(c)
            for c in target.columns
        ]
    )
    return kept.select(*[col(c) for c in target.columns]).unionByName(added)
