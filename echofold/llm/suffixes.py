"""Suffix orders by prefix doubling in numpy, for many short texts at once."""

from __future__ import annotations

import numpy as np


def _classes(key: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys in the slots ``where``: the first slot of each one's class, and whether it has company."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(key)))
    return np.repeat(where[heads], sizes), np.repeat(sizes > 1, sizes)


def suffix_order(key: np.ndarray, end: np.ndarray, first: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions sorted by what stands from there to ``end``, and the ranks by 1, 2, 4, ... times ``first`` symbols.

    ``key`` orders positions by their first ``first`` symbols. Each round sorts only positions that are still tied and
    haven't come to their end; equal suffixes stay in order of position and keep equal ranks.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    starts, tied = _classes(key[order], slots)
    rank[order] = starts
    levels = [rank.astype(np.int32)]
    step = first
    active = slots[tied]
    while len(active):
        at = order[active]
        ahead = at + step
        second = np.where(ahead < end[at], rank[np.minimum(ahead, n - 1)], -1)
        pair = rank[at] * (n + 1) + second + 1
        by = np.argsort(pair, kind="stable")
        order[active] = at[by]
        starts, tied = _classes(pair[by], active)
        rank[at[by]] = starts
        levels.append(rank.astype(np.int32))
        step *= 2
        # Members of a class that have all ended are equal suffixes.
        active = active[tied & (second[by] >= 0)]
    return order, levels
