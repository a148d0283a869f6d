class SpecError(ValueError):
    """A query, policy, model or patch description that must be rejected."""


class ConflictError(RuntimeError):
    """Another writer changed the same part of a table."""
