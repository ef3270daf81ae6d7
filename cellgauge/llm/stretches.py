"""Stretches of an alignment that are long enough and differ little enough.

Both searches first take the stretch of the greatest sum, in which an agreeing
column counts for and a differing one against, at the rate that the permitted
share sets: it ends where agreement ends. That stretch may leave out a side
behind a difference, though the whole would still do; so where it is too short,
the whole is looked for. What is left on both sides is searched in turn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

Span = tuple[int, int]


def _greatest(same: np.ndarray, differing: float) -> Span:
    gain = np.concatenate(([0.0], np.cumsum(np.where(same, differing, differing - 1.0))))
    end = int(np.argmax(gain - np.minimum.accumulate(gain)))
    return int(np.argmin(gain[: end + 1])), end


def _longest(same: np.ndarray, differing: float) -> Span:
    """The longest stretch between agreeing columns with at most the share ``differing`` of differing ones.

    Among begins only new minima of the running sum matter, among ends the last that isn't below.
    """
    whole = round(differing * 10**6)
    gain = np.concatenate(([0], np.cumsum(np.where(same, whole, whole - 10**6))))
    begin = np.flatnonzero(same)
    if not len(begin):
        return 0, 0
    end = begin + 1
    high = np.maximum.accumulate(gain[end][::-1])[::-1]
    low = np.minimum.accumulate(gain[begin])
    begin = begin[np.concatenate(([True], low[1:] < low[:-1]))]
    last = end[np.maximum(np.searchsorted(-high, -gain[begin], side="right") - 1, 0)]
    best = int(np.argmax(last - begin))
    return int(begin[best]), int(last[best])


def _search(same: np.ndarray, enough: Callable[[int, int], bool], find: Callable[[int, int], list[Span]]) -> Iterator[Span]:
    todo = [(0, len(same))]
    while todo:
        a, b = todo.pop()
        for begin, end in find(a, b):
            if begin < end and enough(begin, end):
                yield begin, end
                todo += [(a, begin), (end, b)]
                break


def by_length(same: np.ndarray, least: int, differing: float, ends: float = 0.1) -> Iterator[Span]:
    """Disjoint stretches of ``least`` columns or more, of which at most the share ``differing`` differ.

    They begin and end with agreeing columns, but where they would be too short
    for that, the share ``ends`` of ``least`` may be differing columns at their ends.
    """
    need = max(1, int(np.ceil((1 - differing) * least - 1e-9)))

    def find(a: int, b: int) -> Iterator[Span]:
        on = a + np.flatnonzero(same[a:b])
        if b - a < least or len(on) < need:
            return
        for begin, end in (_greatest(same[a:b], differing), _longest(same[a:b], differing)):
            yield a + begin, a + end
        for m in range(min(len(on), least - 1), need - 1, -1):
            size = on[m - 1:] - on[: len(on) - m + 1] + 1
            some = np.flatnonzero((size < least) & (size >= (1 - ends) * least))
            if len(some):
                begin = min(int(on[some[0]]), b - least)
                yield begin, begin + least
                return

    return _search(same, lambda a, b: b - a >= least, find)


def by_agreement(same: np.ndarray, least: float, differing: float) -> Iterator[Span]:
    """Disjoint stretches in which ``least`` columns or more agree and at most the share ``differing`` of all differ."""
    need = max(1, int(np.ceil(least - 1e-9)))

    def find(a: int, b: int) -> Iterator[Span]:
        on = a + np.flatnonzero(same[a:b])
        if len(on) < need:
            return
        begin, end = _greatest(same[a:b], differing)
        yield a + begin, a + end
        # of twice as many agreeing columns one half would do as well
        for m in range(min(len(on), 2 * need - 1), need - 1, -1):
            size = on[m - 1:] - on[: len(on) - m + 1] + 1
            at = int(np.argmin(size))
            if size[at] - m <= differing * size[at] + 1e-9:
                yield int(on[at]), int(on[at] + size[at])
                return

    return _search(same, lambda a, b: int(same[a:b].sum()) >= need, find)
