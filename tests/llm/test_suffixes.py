import hashlib
import random

import numpy as np
import pytest

from cellgauge.llm.catalog import queries
from cellgauge.llm.suffixes import neighbour_prefixes, substring_dedup, two_stage_order
from tests.conftest import SF
from tests.llm.conftest import DOCS, EDGES, rows


def brute(docs, length=50):
    """Rows of one id are judged against smaller ids only; null ids are the largest."""
    rank = lambda d: (d is None, d or 0)
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first[b[i: i + length]] = min(first.get(b[i: i + length], rank(d)), rank(d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i: i + length]] < rank(d):
                gone[i: i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def told(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()), key=str)


def test_query_equals_brute_force(spark, corpus):
    _, texts = corpus
    assert told(queries()["op6_suffix_dedup"](spark, SF)) == brute(list(texts.items()))


@pytest.mark.parametrize("letters", [1, 2, 3, 256])
def test_two_stage_sort(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 2, 50, 700):
        text = rng.integers(0, letters, n).astype(np.uint8)
        data, order = text.tobytes(), two_stage_order(text, 1024)
        assert order.tolist() == sorted(range(n), key=lambda i: data[i:])
        for i, common in enumerate(neighbour_prefixes(text, order, 64)):
            a, b = (data[j:] + b"\0" * 80 for j in order[i: i + 2])
            assert common == next((k for k in range(64) if a[k] != b[k]), 64)


@pytest.mark.parametrize("hot", [1, 5, 1024])
def test_many_shared_pieces(spark, hot):
    rng = random.Random(hot)
    pieces = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 200))) for _ in range(12)] + ["a" * 120]
    docs = [(rng.randrange(200), "".join(rng.choice(pieces) if rng.random() < 0.5 else str(rng.random()) for _ in range(rng.randrange(8)))) for _ in range(150)]
    docs += [(500 + i, docs[0][1]) for i in range(20)]
    assert told(substring_dedup(spark.createDataFrame(rows(docs), DOCS), hot=hot)) == brute(docs)


def test_edges_and_kept_bytes(spark, edges, nothing):
    assert told(substring_dedup(edges)) == brute(EDGES)
    for r in substring_dedup(edges, with_text=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(r.span_ends) - sum(r.span_starts) == r.n_removed
    assert substring_dedup(nothing).count() == 0
