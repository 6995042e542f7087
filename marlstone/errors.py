"""Errors of the public API."""


class ValidationError(ValueError):
    """A request or a document that breaks the collection's rules."""


class NotFound(LookupError):
    """A collection or document that does not exist."""


class Conflict(RuntimeError):
    """A collection that exists already, or a stale write."""
