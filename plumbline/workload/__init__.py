"""Registered queries over the supplied benchmark tables."""

from . import fusing, lifting, naming, paths, upright  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
