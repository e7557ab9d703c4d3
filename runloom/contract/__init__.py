"""Registered queries over the given tables, with their SQL counterparts."""

from runloom.contract import datasets, files, models, records, store, text  # noqa: F401  (they register)
from runloom.contract.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
