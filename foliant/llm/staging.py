"""Staged tables, and what a worker process keeps for its next tasks."""

from __future__ import annotations

from ..staging import made, release, shared_dir, staged

__all__ = ["held_by_worker", "made", "release", "shared_dir", "staged"]

_held: dict = {}


def held_by_worker(key: tuple, build):
    """What ``build`` gives, kept for the worker process's next tasks.

    A worker keeps one such thing only: the next operator's replaces it, so caches of
    operators that are done don't add up.
    """
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]
