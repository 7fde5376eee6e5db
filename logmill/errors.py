"""The one error type of the package."""


class LogError(ValueError):
    """An argument or a document is not acceptable."""
