"""Legal texts to tables on Spark.

What is exported is loaded on first use, so that workers which need one module import no other.
"""

_EXPORTS = {"parse_structure": "structure", "extract_cross_references": "structure", "parse_documents": "document"}

__all__ = ["__version__", *_EXPORTS]
__version__ = "0.2.0"


def __getattr__(name: str) -> object:
    if name not in _EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    import importlib

    return getattr(importlib.import_module(f".plans.{_EXPORTS[name]}", __name__), name)
