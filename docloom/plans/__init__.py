"""The registered queries: operators bound to the given tables, with their SQL."""

from . import dates, evaluate, how, index, pages, report, search, upkeep, vectors, what, when  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
