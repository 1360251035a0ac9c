"""What a worker process loads once and keeps over its tasks.

Functions travel to the workers by value, with their globals, so a cache of this package would begin
empty with every task, or need an installed copy. What was loaded is kept with the interpreter.
"""

from __future__ import annotations

import functools
import sys


def once_per_worker(load):
    """load(path), called once per path in each process."""
    name = f"{load.__module__}.{load.__qualname__}"

    @functools.wraps(load)
    def get(path: str):
        kept = vars(sys).setdefault("_kept_by_voltloom", {})
        if (name, path) not in kept:
            kept[name, path] = load(path)
        return kept[name, path]

    return get
