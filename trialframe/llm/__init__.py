"""Operators for training-data pipelines over documents, pages and vectors."""

from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
