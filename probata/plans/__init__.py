"""Queries built from the operators, with their SQL twins."""

from . import evidence, groups, lakehouse, monitoring, scalars
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "evidence", "groups", "lakehouse", "monitoring", "scalars"]
