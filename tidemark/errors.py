"""Failures of the store, one class for each kind."""


class StoreError(Exception):
    """Any failure of the store."""


class NotFound(StoreError):
    """The key has no live version."""


class Corruption(StoreError):
    """Stored state contradicts itself."""


class NotSupported(StoreError):
    """The operation is not offered for this store."""


class InvalidArgument(StoreError):
    """A value is outside its limits."""


class CommitConflict(StoreError):
    """Another writer published a version first."""


class Frozen(StoreError):
    """The store is closed."""
