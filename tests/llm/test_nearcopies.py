import random

import numpy as np
import pyarrow as pa
import pytest

from cellgauge.llm.nearcopies import agreement, near_copies, one_of_each, shingle_hashes, sketches
from cellgauge.llm.text import Texts
from tests.llm.conftest import DOCS, prose, rows
from tests.llm.test_simhash import groups, shingles


def similarity(a, b):
    x, y = set(shingles(a, 5)), set(shingles(b, 5))
    return len(x & y) / len(x | y)


def edited(words, n, rng):
    own = list(words)
    for k in rng.sample(range(len(words)), n):
        own[k] = f"x{rng.randrange(10**9)}"
    return " ".join(own)


@pytest.mark.parametrize("n", [20, 60, 300, 2000])
def test_sketches_tell_similarity(n):
    rng = random.Random(n)
    pairs = [(" ".join(w), edited(w, rng.randrange(max(2, n // 15)), rng)) for w in (prose(i, n).split() for i in range(300))]
    h, count = shingle_hashes(Texts.of(pa.array([t for p in zip(*pairs) for t in p])), 5)
    marks = sketches(h, count).view(np.uint64)
    error = agreement(marks[:300], marks[300:]) - np.array([similarity(a, b) for a, b in pairs])
    assert abs(error.mean()) < 0.01 and error.std() < 0.02


def test_recall_and_precision(spark):
    """Families of one text and one edited copy, of all similarities between 0.6 and 1."""
    rng, docs = random.Random(7), []
    for i in range(400):
        n = rng.choice([40, 120, 400, 1200])
        words = prose(1000 + i, n).split()
        docs += [(2 * i, " ".join(words)), (2 * i + 1, edited(words, max(1, round(n * rng.uniform(0, 0.05))), rng))]
    found = {r.doc_id: r.component for r in near_copies(spark.createDataFrame(rows(docs), DOCS)).collect()}
    texts = dict(docs)
    pairs = {i: similarity(texts[2 * i], texts[2 * i + 1]) for i in range(400)}
    linked = {i for i in pairs if found[2 * i] == found[2 * i + 1]}
    near = {i for i, s in pairs.items() if s >= 0.8}
    assert len(near) > 100 and len(linked & near) >= 0.97 * len(near)
    assert len(linked & near) >= 0.9 * len(linked) and all(pairs[i] > 0.74 for i in linked)
    assert all(c // 2 == d // 2 for d, c in found.items())


def test_corpus_groups(spark, corpus):
    """Between the groups of 0.8 and those of 0.75, worked out exactly, and nearly always the former."""
    docs, texts = corpus
    alike = {(a, b): similarity(texts[a], texts[b]) for a in texts for b in texts if b < a and shingles(texts[a], 5) and shingles(texts[b], 5)}
    at = [groups(sorted(texts), lambda a, b, s=s: texts[a] == texts[b] or alike.get((a, b), 0) >= s) for s in (0.75, 0.8)]
    found = {r.doc_id: r.component for r in near_copies(docs).collect()}
    assert all(at[0][d] <= found[d] <= at[1][d] for d in texts)
    assert sum(found[d] != at[1][d] for d in texts) <= 2 < len(set(at[1].values()))
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == sorted(set(found.values()))


def test_edges(spark, edges, nothing):
    kept = one_of_each(edges).collect()
    # the texts of 1 and 2 and of a row without id are empty, those of 5 and 9 copies
    assert sorted((r.doc_id for r in kept if r.doc_id), key=int) == [1, 3, 4, 6, 7, 8, 10, 11]
    assert [r.text for r in kept if r.doc_id is None] == ["no id here at all"]
    assert kept[0].asDict().keys() == edges.limit(1).collect()[0].asDict().keys()
    assert one_of_each(nothing).count() == 0


def test_repeated_ids_and_rows_without_id(spark):
    a, b, c = prose(1, 50), prose(2, 50), prose(3, 50)
    docs = [(1, a), (1, b), (1, a), (None, b), (None, c), (None, c), (5, c)]
    kept = one_of_each(spark.createDataFrame(rows(docs), DOCS)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", a), ("1", b), ("5", c)])


def test_large_groups(spark):
    """Hundreds of copies of one text with a word changed each, and a chain of texts each near the next only."""
    words, rng = prose(1, 300).split(), random.Random(1)
    docs = [(i, edited(words, 1, rng)) for i in range(400)]
    own = prose(2, 300).split()
    for i in range(12):
        docs.append((1000 + i, " ".join(own)))
        own = edited(own, 3, rng).split()
    docs.append((2000, prose(3, 300)))
    found = {r.doc_id: r.component for r in near_copies(spark.createDataFrame(rows(docs), DOCS)).collect()}
    assert {found[i] for i in range(400)} == {0} and {found[1000 + i] for i in range(12)} == {1000} and found[2000] == 2000


def test_near_copy_behind_many_lesser_ones(spark):
    """One partner above the similarity among many well below it, which come first."""
    docs = []
    for g in range(3):
        words = prose(50 + g, 300).split()
        for m in range(61):  # 11 of 300 words changed: 0.68; the last 5: 0.85
            own = list(words)
            for k in range(11 if m < 60 else 5):
                own[(m + 26 * k) % 280 + 10] = f"g{g}m{m}k{k}"
            docs.append((100 * g + m, " ".join(own)))
        docs.append((100 * g + 99, " ".join(words)))
    sets = {d: frozenset(shingles(t, 5)) for d, t in docs}
    expected = groups(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert all(expected[100 * g + 99] == 100 * g + 60 for g in range(3))
    assert {r.doc_id: r.component for r in near_copies(spark.createDataFrame(rows(docs), DOCS)).collect()} == expected


def test_rows_do_not_grow_with_the_pairs(spark):
    """A family of n texts leaves its buckets with at most n rows each."""
    from cellgauge.llm import nearcopies as M

    words, rng = prose(9, 200).split(), random.Random(9)
    texts = pa.array([edited(words, 2, rng) for _ in range(300)])
    h, count = shingle_hashes(Texts.of(texts), 5)
    marks = [m.tobytes() for m in sketches(h, count)]
    fp = M.majority(h, count).view(np.int64)
    lanes = pa.RecordBatch.from_arrays([pa.array(np.repeat([1, 2], 300)), pa.array(np.tile(fp, 2)), pa.array(np.tile(np.arange(300), 2)), pa.array(marks * 2, pa.binary())], ["key", "fp", "vertex", "sketch"])
    assert sum(b.num_rows for b in M._buckets(22, 0.785)(iter([lanes]))) <= 2 * 299


def test_dense_buckets_take_little_memory():
    """A bucket in which all fingerprints are equal and no sketches agree: all pairs are compared, a few at a time."""
    import tracemalloc

    from cellgauge.llm import nearcopies as M

    n = 2000
    marks = [m.tobytes() for m in np.random.default_rng(3).integers(0, 256, (n, M.SKETCH), np.uint8)]
    marks[n - 1] = marks[n - 2]
    lanes = pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int64)), pa.array(np.full(n, 7)), pa.array(np.arange(n)), pa.array(marks, pa.binary())], ["key", "fp", "vertex", "sketch"])
    tracemalloc.start()
    found = [b.to_pydict() for b in M._buckets(22, 0.785)(iter([lanes]))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [{"a": [n - 1], "b": [n - 2]}]
    assert most < 80e6
