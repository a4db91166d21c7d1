"""What a Python worker keeps from task to task: one thing at a time, and only while it is in use.

Workers outlive stages. Without this, what several stages have learnt would add up in an
executor's memory and stay there while the JVM works alone.
"""

from __future__ import annotations

import ctypes
import gc
import threading
import time
from collections.abc import Callable, Hashable
from typing import Any

IDLE_S = 3.0

_held: dict[Hashable, Any] = {}
_lock = threading.Lock()
_used = [0.0, False]  # time of the last use, whether a watcher runs


def _release() -> None:
    """Give freed memory back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def _watch() -> None:
    while True:
        time.sleep(1)
        with _lock:
            if not _held or time.monotonic() - _used[0] <= IDLE_S:
                if _held:
                    continue
            _held.clear()
            _used[1] = False
        _release()
        return


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The thing kept under key; another key's thing is let go first. Call it for each batch: it marks the time."""
    with _lock:
        _used[0] = time.monotonic()
        if key in _held:
            return _held[key]
        other = bool(_held)
        _held.clear()
    if other:
        _release()
    thing = make()
    with _lock:
        _held.clear()
        _held[key] = thing
        _used[0] = time.monotonic()
        if not _used[1]:
            _used[1] = True
            threading.Thread(target=_watch, daemon=True).start()
    return thing
