"""Text rules: normalisation and e-mail validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import col, collapse_ws, is_text, strip_ws, valid_email
from .dedup import _as_list


def normalize_text(df: DataFrame, config: dict) -> DataFrame:
    """Config: ``columns`` (default all text columns), ``lowercase`` (True), ``strip`` (True).

    Strip, lower-case, collapse runs of white space to one blank; the text ``nan`` becomes null. Nulls stay null.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = _as_list(config.get("columns")) or [c for c in df.columns if is_text(types[c])]
    strip, lowercase = config.get("strip", True), config.get("lowercase", True)
    new = {}
    for c in (c for c in wanted if c in types):
        if not is_text(types[c]) and not strip:
            raise ValueError(f"normalize_text: {c} is not a text column")
        text = col(c) if is_text(types[c]) else col(c).cast("string")
        if strip:
            text = strip_ws(text)
        if lowercase:
            text = F.lower(text)
        new[c] = F.nullif(collapse_ws(text), F.lit("nan"))
    return df.withColumns(new) if new else df


def validate_email(df: DataFrame, config: dict) -> DataFrame:
    """Config: ``column`` ('email'), ``action`` ('nullify' or 'drop'). A missing address is not invalid."""
    name = config.get("column", "email")
    if name not in df.columns:
        return df
    address = col(name).cast("string")
    if config.get("action", "nullify") == "drop":
        return df.filter(address.isNull() | valid_email(address))
    return df.withColumn(name, F.when(valid_email(address), col(name)))
