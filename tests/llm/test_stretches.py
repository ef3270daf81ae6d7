import numpy as np
import pytest

from cellgauge.llm.contamination import overlaps
from cellgauge.llm.stretches import by_agreement, by_length


def masks(seed, n=400):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        size = int(rng.integers(0, 60))
        yield rng.random(size) < rng.choice([0.3, 0.7, 0.8, 0.85, 0.95])


def spans(same):
    """All stretches between agreeing columns: begin, end, columns that agree."""
    total = np.concatenate(([0], np.cumsum(same)))
    return [(a, b, total[b] - total[a]) for a in np.flatnonzero(same) for b in np.flatnonzero(same) + 1 if b > a]


def long_ones(same, share, least):
    found = [(a, b) for a, b, m in spans(same) if b - a >= least and b - a - m <= share * (b - a) + 1e-9]
    if len(same) >= least:  # differing columns at the ends fill up
        found += [(a, b) for a, b, m in spans(same) if 0.9 * least <= b - a < least and m >= (1 - share) * least - 1e-9]
    return found


def agreeing_ones(same, share, least):
    return [(a, b) for a, b, m in spans(same) if m >= least and b - a - m <= share * (b - a) + 1e-9]


@pytest.mark.parametrize("share", [0.2, 0.1, 0.0])
def test_found_whenever_there_is_one(share):
    for least in (5, 12):
        for same in masks(least):
            for found, want in ((list(by_length(same, least, share)), long_ones(same, share, least)), (list(by_agreement(same, least, share)), agreeing_ones(same, share, least))):
                assert bool(found) == bool(want)
                assert all(a[1] <= b[0] or b[1] <= a[0] for a in found for b in found if a != b)
                assert all((~same[a:b]).sum() <= share * (b - a) + 1e-9 for a, b in found)
                # nothing qualifies outside what was found
                taken = np.zeros(len(same), bool)
                for a, b in found:
                    taken[a:b] = True
                assert all(taken[a:b].any() for a, b in want)


def test_every_place_of_one_substitution():
    item = np.arange(12)
    for k in range(12):
        doc = np.concatenate((np.full(9, 99), item, np.full(9, 98)))
        doc[9 + k] = 97
        assert [n in (10, 11) for *_, n in overlaps(doc, item, 9, 0.2, min(10, 0.8 * 12))] == [True]


def test_ends_where_agreement_ends():
    same = np.array([False] * 20 + [True] * 60 + [False] * 9 + [True] + [False] * 20)
    assert list(by_length(same, 50, 0.2)) == [(20, 80)] and list(by_agreement(same, 10, 0.2)) == [(20, 80)]
