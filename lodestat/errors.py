"""Exceptions raised by the profiling operators."""

from __future__ import annotations


class ProfilingError(Exception):
    """Base class of every error the library raises on purpose."""


class ColumnNotFound(ProfilingError):
    """A named column is missing or is not numeric."""

    def __init__(self, column: str):
        super().__init__(f"column not found or not numeric: {column}")
        self.column = column


class EmptyDataset(ProfilingError):
    """An operator that divides by the row count was given no rows."""


class InsufficientData(ProfilingError):
    """A series or argument is shorter than the operator needs."""

    def __init__(self, needed: int):
        super().__init__(f"insufficient data: need at least {needed}")
        self.needed = needed


class NotEnoughColumns(ProfilingError):
    """A matrix operator needs more numeric columns than there are."""


class InvalidPredictionTask(ProfilingError):
    """The target's labels do not fit the requested prediction type."""
