"""Queries over the driver's tables, one or more per operator, each with its SQL where SQL can say it."""

from lociframe.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
