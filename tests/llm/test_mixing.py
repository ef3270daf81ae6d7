from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cellgauge.llm.mixing import mix_plan, mix_sources, water_fill
from tests.llm.conftest import EDGES, prose


def filled(sizes, weights, epochs, total):
    """Clamp and share out again until nothing is above."""
    target, clamped = {}, set()
    while True:
        rest, shares = total - sum(epochs * sizes[s] for s in clamped), {s: weights[s] for s in sizes if s not in clamped}
        target = {s: epochs * sizes[s] if s in clamped else rest * w / sum(shares.values()) for s, w in {**weights, **shares}.items()}
        above = {s for s in shares if target[s] > epochs * sizes[s]}
        if not above:
            return target
        clamped |= above


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 5, "c": 10, "d": 1000, "e": 0}, {"a": 7}, {"a": 10, "b": 1, "c": 1, "d": 1, "e": 2000}])
def test_water_fill(spark, sizes):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    frame = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight long")
    got = {r.source: r.target for r in water_fill(frame).collect()}
    assert got == pytest.approx(filled(sizes, weights, 3, sum(sizes.values())))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_is_near_its_targets(spark):
    docs = [(i, prose(i, 20 + i % 50), "big" if i % 3 else f"s{i % 8}" if i % 5 else None) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    plan = mix_plan(frame).collect()
    assert len(plan) == 3000 and sorted(map(str, plan)) == sorted(map(str, mix_plan(frame.repartition(7)).collect()))
    taken, target = defaultdict(int), {}
    for r in plan:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.repeats * r.size <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 70 for s in target)
    mixed = mix_sources(frame).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("epoch").alias("top")).collect()
    assert {r.doc_id: r.n for r in mixed} == {r.doc_id: r.repeats for r in plan if r.repeats} and all(r.n == r.top for r in mixed)


def test_edges(edges, nothing):
    plan = mix_plan(edges).collect()
    assert len(plan) == len(EDGES) and {(r.doc_id, r.size) for r in plan} == {(d, len((t or "").split())) for d, t in EDGES}
    assert mix_sources(edges).columns == [*(c for c in edges.columns if c != "epoch"), "epoch"]
    assert mix_plan(nothing).count() == 0 and mix_sources(nothing).count() == 0
