"""Exceptions raised by the comparison engine."""


class DeltaloomError(Exception):
    """Root of everything this package raises on purpose."""


class ConfigError(DeltaloomError):
    """The configuration, or the schemas it meets, cannot be compared as asked."""


class DataIntegrityError(DeltaloomError):
    """The data breaks a precondition of the comparison, such as unique keys."""
