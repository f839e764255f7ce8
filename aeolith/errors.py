"""Errors with a meaning for callers."""


class ResourceError(Exception):
    """A request the data cannot answer."""


class ResourceKeyError(ResourceError, KeyError):
    """A dataset or attribute is missing."""


class ResourceValueError(ResourceError, ValueError):
    """A coordinate or value lies outside the data."""


class ResourceRuntimeError(ResourceError, RuntimeError):
    """Files do not fit together."""


class ExtrapolationWarning(Warning):
    """A height lies outside the stored heights."""


class ResourceWarning(Warning):
    """Something was replaced or passed over."""
