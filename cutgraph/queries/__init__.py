"""Every query by name, with its oracle where SQL can express it."""

from . import functions, intervals, plans, retrieval, scans, sessions, signals, texts  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
