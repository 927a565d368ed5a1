"""The engine's own queries and their SQL."""

from __future__ import annotations

from .plans import citations, corpus, files, logs, scoring, search, streams  # noqa: F401  (they register)
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
