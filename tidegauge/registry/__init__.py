"""Named queries over the given tables, with the SQL that yields the same rows where SQL can."""

from . import arima, cleaning, dependence, inputs, models, profiles, quality, rowwise, windows
from .base import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES",
    "cleaning", "dependence", "inputs", "models", "profiles", "quality", "rowwise", "windows",
]
