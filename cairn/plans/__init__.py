"""The engine's queries and their registry."""


def load() -> None:
    """Imports every module that registers queries."""
    from . import basics, discovery, fulltext, guards, matching, publication, reports, resolution  # noqa: F401
