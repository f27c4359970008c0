"""All queries of this subpackage and their SQL."""

from . import balltree, bpe, exact, html, jaccard, lm, manifest  # noqa: F401
from . import packing, resampling, rules, secrets, toxicity, whitening  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
