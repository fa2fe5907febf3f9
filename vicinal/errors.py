"""Errors of the library, one for each part that can fail."""


class VicinalError(Exception):
    """Base of all errors raised here."""


class ConfigError(VicinalError, ValueError):
    """A configuration is invalid; the message lists every violation."""


class ShapeError(VicinalError, ValueError):
    """Records that are compared have no values, or are of different shape or dimension."""


class ComparatorError(VicinalError, ValueError):
    """A comparator, or its signature generator, is unknown or does not fit."""


class NormalizerError(VicinalError, ValueError):
    """A normalizer is unknown."""


class IndexCreationError(VicinalError, ValueError):
    """An index cannot be built of these records."""


class CacheError(VicinalError, ValueError):
    """A mutation does not fit the state of its index."""


class SearchError(VicinalError, ValueError):
    """A search argument or a similarity is out of its range."""


class StoreError(VicinalError, RuntimeError):
    """A segment store was changed by another writer meanwhile."""
