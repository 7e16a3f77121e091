"""User extension points: a function named by ``module:function``."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column


def load(name: str) -> Callable[[Column], Column]:
    """The Column function that ``module:function`` names; a wrong name is an error before any job starts."""
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"expected module:function, got {name!r}")
    found = getattr(importlib.import_module(module), function)
    if not callable(found):
        raise TypeError(f"{name} is not callable")
    return found
