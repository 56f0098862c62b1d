"""Errors raised by the eager checks."""


class DataError(ValueError):
    """Input data break a rule that the job depends on."""


class MissingTableError(DataError):
    """A required table is absent, unreadable or empty."""
