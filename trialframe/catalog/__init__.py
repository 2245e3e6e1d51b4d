"""Every operator run over the test tables, each with its SQL where SQL can say it."""

from . import basics, composites, models, ordinations, tables  # noqa: F401  (they fill the registry)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
