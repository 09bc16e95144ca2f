"""spindrift: a PySpark-native engine for searching change histories and preparing text corpora.

The names below are loaded when they are first used, so that workers that need a single module load no more.
"""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

_NAMES = {
    "spindrift.api": (
        "Context", "EngineError", "ExpertExistsError", "ExpertNotFoundError", "InvalidIndexError", "NoResultsError",
        "import_expert", "list_experts", "populate", "prompt_expert", "prompt_expert_stream", "prompt_expert_stream_async", "query_expert",
    ),
    "spindrift.plans.search": ("Engine", "QueryParams"),
    "spindrift.operators.store": ("Store",),
    "spindrift.functions.models": ("EMBEDDERS", "GENERATORS", "RERANKERS", "Generated", "Usage"),
    "spindrift.functions.providers": ("Settings",),
    "spindrift.sources.history": ("register",),
}
_WHERE = {name: module for module, names in _NAMES.items() for name in names}

__all__ = sorted(_WHERE)


def __getattr__(name: str) -> object:
    if name not in _WHERE:
        raise AttributeError(f"module 'spindrift' has no attribute {name!r}")
    return getattr(importlib.import_module(_WHERE[name]), name)


def __dir__() -> list[str]:
    return [*__all__, "__version__"]
