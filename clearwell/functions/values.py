"""Column expressions shared by the rules, checks and profiles. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters the text rules count as white space.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS_RUN = r"(?U)[\s\x1c-\x1f]+"

# Which texts count as a decimal number, a whole number and an e-mail address.
NUMBER_PATTERN = r"^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$"
WHOLE_PATTERN = r"^[+-]?[0-9]+$"
EMAIL_PATTERN = r"^[\w.+-]+@[\w-]+\.[\w.]+$"

TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")


def col(name: str) -> Column:
    """A column by its exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(is_orderable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return is_orderable(dtype.elementType)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def strip_ws(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def rstrip_ws(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, WS_RUN, " ")


def nan_to_null(c: Column, dtype: T.DataType) -> Column:
    return F.nanvl(c, F.lit(None).cast(dtype)) if is_fractional(dtype) else c


def to_number(c: Column, dtype: T.DataType) -> Column:
    """Double value, or null for anything that is not plainly a number.

    Spark's own cast also reads ``1d`` and ``1f``, so text passes a pattern first.
    """
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if is_numeric(dtype):
        return nan_to_null(c.cast("double"), T.DoubleType())
    if is_text(dtype):
        text = strip_ws(c)
        return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.lit(None).cast("double")


def to_whole_number(c: Column, dtype: T.DataType) -> Column:
    """Long value, or null for anything that is not a whole number."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return c.cast("long")
    number = to_number(c, dtype)
    rounded = F.when(number == F.floor(number), number.try_cast("long"))
    if not is_text(dtype):
        return rounded
    text = strip_ws(c)
    return F.when(text.rlike(WHOLE_PATTERN), text.try_cast("long")).otherwise(rounded)


def parse_timestamp(c: Column, dtype: T.DataType, formats: Sequence[str] = ()) -> Column:
    """First format that fits wins; without formats the ISO forms are read."""
    if is_temporal(dtype):
        return c.cast("timestamp")
    if is_numeric(dtype):
        # Plain numbers count as nanoseconds since the epoch.
        return F.timestamp_micros(F.floor(to_number(c, dtype) / 1000).cast("long"))
    if not is_text(dtype):
        return F.lit(None).cast("timestamp")
    text = strip_ws(c)
    if not formats:
        return text.try_cast("timestamp")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_bool(c: Column, dtype: T.DataType, truthy: bool = False) -> Column:
    """Boolean by meaning, or with ``truthy`` by emptiness: only false, 0 and '' are false, null is true
    for numbers (a missing number is NaN) and false for text."""
    if truthy:
        if is_text(dtype):
            return F.coalesce(c != "", F.lit(False))
        if is_numeric(dtype):
            return F.coalesce(c != 0, F.lit(True))
        if isinstance(dtype, T.BooleanType):
            return F.coalesce(c, F.lit(False))
        return c.isNotNull()
    if isinstance(dtype, T.BooleanType):
        return c
    if is_numeric(dtype):
        return nan_to_null(c, dtype) != 0
    if is_text(dtype):
        word = F.lower(strip_ws(c))
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    return F.lit(None).cast("boolean")


def valid_email(c: Column) -> Column:
    return c.rlike("(?Ud)" + EMAIL_PATTERN)


def starts_with_pattern(c: Column, pattern: str) -> Column:
    """Pattern anchored at the start only, the way a prefix match works."""
    return c.rlike(f"^(?:{pattern})")
