"""viewtide: incrementally maintained, hierarchical, ordered and limited views on Spark."""

from importlib import import_module

_PLACES = {"EngineRegistry": "engine", "ViewEngine": "engine", "Query": "plans.ast", "parse_query": "plans.ast", "q": "plans.ast", "TableSpec": "sources.catalog"}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    """Loads what is asked for; Python workers that import a submodule load nothing else."""
    if name in _PLACES:
        return getattr(import_module(f"viewtide.{_PLACES[name]}"), name)
    raise AttributeError(name)
