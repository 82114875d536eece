"""Memory of Python workers, which Spark reuses for one operator's tasks after another's.

A worker keeps one cache, that of the operator at work: a task of another one
drops it before it starts. At a task's end freed memory goes back to the
system, where the allocators would otherwise keep the task's peak."""

from __future__ import annotations

import functools

from langmix.operators.batches import release

BATCH_ROWS = 1024        # whole rows handed on at once
_CACHES: dict[str, object] = {}


def cached(name: str, make):
    """The worker's cache of that name; another one is dropped first."""
    if name not in _CACHES:
        _CACHES.clear()
        _CACHES[name] = make()
    return _CACHES[name]


def tidy(run, keep: str | None = None):
    """``run`` for ``mapInArrow``: caches of other operators (all but those whose name begins with ``keep``) go before
    the first batch, freed memory after the last."""
    @functools.wraps(run)
    def tidied(batches):
        for name in [n for n in _CACHES if keep is None or not n.startswith(keep)]:
            del _CACHES[name]
        try:
            yield from run(batches)
        finally:
            release()
    return tidied


def slices(batches, rows: int = BATCH_ROWS):
    """The batches in parts of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
