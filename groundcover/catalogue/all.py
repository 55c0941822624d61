"""Imports every catalogue module, which registers its queries."""

from groundcover.catalogue import cleaning, evidence, matching, serving  # noqa: F401
from groundcover.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
