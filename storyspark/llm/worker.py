"""What a Python worker keeps between tasks."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import Any

_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    """The object of ``key``, built by the first task of a worker that asks for it. A
    worker holds one at a time, so the caches of an operator go when
    the tasks of another one reach the worker."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = build()
    return _HELD[key]
