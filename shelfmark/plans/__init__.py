"""Registered queries: every operator on the benchmark tables, with its SQL twin."""

from . import changes, descriptors, files, locations, nested, robust, searching, tables, validation
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
