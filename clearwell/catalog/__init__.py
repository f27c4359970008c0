"""Named queries over the given tables, each with the SQL that states its result."""

from . import entries, loads, quality, reports, rules  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
