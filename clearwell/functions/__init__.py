from .values import (  # noqa: F401
    collapse_ws,
    col,
    nan_to_null,
    parse_bool,
    parse_timestamp,
    strip_ws,
    to_number,
    to_whole_number,
)
