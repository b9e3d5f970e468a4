"""Errors of the engine."""


class MillraceError(Exception):
    """Any statement that cannot be parsed, bound or run."""
