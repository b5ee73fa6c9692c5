"""Errors raised by the engine itself."""


class QueryError(ValueError):
    """A statement that cannot be run; the message names what is wrong."""
