"""What can go wrong with a store."""


class StoreError(Exception):
    """Any error of the engine."""


class NotFound(StoreError, KeyError):
    """No visible value for the key."""


class Corruption(StoreError, ValueError):
    """Stored bytes or rows don't follow their format."""


class InvalidArgument(StoreError, ValueError):
    """An option or argument out of its range."""


class Conflict(StoreError):
    """Another writer committed first."""
