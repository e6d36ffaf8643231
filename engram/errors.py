"""Typed errors."""


class EngramError(Exception):
    """Base of all errors of this package."""


class ValidationError(EngramError, ValueError):
    """An argument or a record breaks a rule."""


class ProfileMismatchError(EngramError):
    """The store holds another embedding profile."""


class StoreError(EngramError):
    """The store cannot be read or written."""


class BusyError(StoreError):
    """Another writer holds the store's lock."""


class DuplicateKeyError(StoreError):
    """A record with this key exists."""


class EnvelopeError(ValidationError):
    """A JSON Lines export breaks its format."""


class ImportConflictError(EngramError):
    """A record to import exists with other content."""
