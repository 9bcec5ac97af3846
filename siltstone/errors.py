"""Typed failures of the engine."""


class EngineError(Exception):
    """Base of every error this package raises on purpose."""


class InvalidInput(EngineError):
    """A request that is refused before it has any effect."""


class Corrupted(EngineError):
    """Stored data contradicts itself; nothing is repaired silently."""


class StorageError(EngineError):
    """A file operation failed or the store changed underneath the caller."""


class NotFound(EngineError):
    """A named thing does not exist."""
