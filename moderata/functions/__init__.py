"""Column-level helpers: derived columns and predicates."""

from . import columns, filters  # noqa: F401
