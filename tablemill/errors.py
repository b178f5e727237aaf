"""The one exception type raised for a request that cannot be carried out as written."""


class SpecError(ValueError):
    """A query, file request or configuration is invalid; the message says why."""
