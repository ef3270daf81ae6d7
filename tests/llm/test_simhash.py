import numpy as np
import pytest
import xxhash

from cellgauge.llm.catalog import queries
from cellgauge.llm.components import components
from cellgauge.llm.simhash import close_pairs, simhash_components
from tests.conftest import SF
from tests.llm.conftest import DOCS, EDGES, prose, rows

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, n):
    w = (text or "").encode().translate(FOLD).split()
    return [b" ".join(w[i: i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []


def fingerprint(text):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if find(a) != find(b) and linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_query_equals_brute_force(spark, corpus):
    _, texts = corpus
    fps = {d: fingerprint(t) for d, t in texts.items()}
    expected = groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op1_simhash"](spark, SF).collect()}
    assert got == {d: (f"{fps[d]:016x}", expected[d]) for d in fps}


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 16])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 6).astype(np.uint64)
    fp = np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (150, 3)).astype(np.uint64), axis=1) for b in base])
    key = np.sort(rng.integers(0, 4, len(fp)))
    expected = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if key[i] == key[j] and int(fp[i] ^ fp[j]).bit_count() <= radius}
    got = [(int(i), int(j)) for a, b in close_pairs(fp, key, radius) for i, j in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == expected


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(8, 60)] + [(3, 3), (None, 4), (200, 9)]
    got = {r.member: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {j: 7 for j in range(8, 60)} | {200: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(edges, nothing):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(edges).collect()]
    assert len(got) == len(EDGES)
    zero = [g for g in got if g[1] == "0" * 16]
    assert {g[0] for g in zero} == {1, 2, 3, None} and {g[2] for g in zero} == {1}
    assert {g[2] for g in got if g[0] in (4, 5)} == {4} and {g[2] for g in got if g[0] in (8, 9)} == {8}
    assert [g[2] for g in got if g[0] is None and g[1] != "0" * 16] == [None]
    assert simhash_components(nothing).count() == 0
