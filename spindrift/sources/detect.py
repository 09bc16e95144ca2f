"""Which version control a workspace has."""

from __future__ import annotations

from spindrift.sources.history import PROVIDERS


def detect(path: str | None) -> str | None:
    """git, p4 or None; the first that recognises the path."""
    if not path or not path.strip():
        return None
    return next((name for name, make in PROVIDERS.items() if make().detect(path)), None)
