"""What a Python worker process keeps between tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_STATE: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object of a key, made once per worker.  A worker that turns to another key lets the last one go, so that the
    vocabularies and models of several stages never add up in one process."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]
