"""What the library offers: every operator with its first line of help."""

from __future__ import annotations

import importlib
import inspect
import pkgutil

import geoloom.operators


def tools() -> dict[str, str]:
    """name (module.function): help, of all operators."""
    found = {}
    for m in pkgutil.iter_modules(geoloom.operators.__path__):
        module = importlib.import_module(f"geoloom.operators.{m.name}")
        for name, f in inspect.getmembers(module, inspect.isfunction):
            if f.__module__ == module.__name__ and not name.startswith("_"):
                found[f"{m.name}.{name}"] = (inspect.getdoc(f) or name.replace("_", " ")).split("\n")[0]
    return found


def search(word: str) -> dict[str, str]:
    """Tools whose name or help has ``word``."""
    return {k: v for k, v in tools().items() if word.lower() in f"{k} {v}".lower()}


def parameters(name: str) -> dict[str, str]:
    """A tool's parameters and their defaults."""
    module, _, f = name.partition(".")
    s = inspect.signature(getattr(importlib.import_module(f"geoloom.operators.{module}"), f))
    return {p.name: "" if p.default is p.empty else repr(p.default) for p in s.parameters.values()}
