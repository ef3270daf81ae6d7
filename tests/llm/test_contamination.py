import random
import re

from cellgauge.llm.catalog import queries
from cellgauge.llm.contamination import clean_documents, contaminations
from tests.conftest import SF
from tests.llm.conftest import DOCS, EDGES, prose, rows

ITEMS = "item_id long, text string, h string, item string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def test_query_finds_every_verbatim_item(spark, corpus):
    _, texts = corpus
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    padded = {d: " " + " ".join(words(t)) + " " for d, t in texts.items()}
    expected = {(d, i) for d, t in padded.items() for i, w in items.items() if " " + " ".join(w) + " " in t}
    got = queries()["op3_decontaminate"](spark, SF).collect()
    assert expected and expected <= {(r.doc_id, r.item_id) for r in got}
    for r in got:  # what is reported does agree
        here, there = words(texts[r.doc_id])[r.first_word: r.last_word + 1], items[r.item_id][r.item_first: r.item_last + 1]
        assert len(here) == len(there) and sum(a == b for a, b in zip(here, there)) == r.n_same >= min(10, 0.8 * len(items[r.item_id]))
        assert r.n_same >= 0.8 * len(here)


def test_substitutions(spark):
    rng = random.Random(5)
    item = prose(50, 40).split()
    docs, expected = [], set()
    for i in range(60):
        changed = list(item)
        for k in rng.sample(range(40), i % 7):  # up to 6 of 40
            changed[k] = f"x{k}"
        docs.append((i, f"{prose(100 + i, 50)} {' '.join(changed)}, {prose(200 + i, 50)}"))
        expected.add(i)
    docs += [(1000 + i, prose(300 + i, 150)) for i in range(40)] + [(2000, prose(9, 50) + " " + " ".join(item[:8]) + " " + prose(10, 50))]
    items = spark.createDataFrame([(1, " ".join(item), "", "")], ITEMS)
    frame = spark.createDataFrame(rows(docs), DOCS)
    assert {r.doc_id for r in contaminations(frame, items).collect()} == expected
    assert {r.doc_id for r in clean_documents(frame, items).collect()} == {d for d, _ in docs} - expected
    tiny = contaminations(frame, items, filter_bits=7)  # the filter only saves work
    assert tiny.exceptAll(contaminations(frame, items)).count() == 0 and tiny.count() >= 60


def test_every_stretch_of_a_diagonal(spark):
    item = prose(60, 60).split()
    changed = [w if i < 20 or i >= 35 else f"x{i}" for i, w in enumerate(item)]
    docs = [(1, f"{prose(61, 30)} {' '.join(changed)} {prose(62, 30)}")]
    items = spark.createDataFrame([(1, " ".join(item), "", "")], ITEMS)
    got = contaminations(spark.createDataFrame(rows(docs), DOCS), items).collect()
    assert sorted((r.first_word, r.last_word, r.item_first, r.item_last, r.n_same) for r in got) == [(30, 49, 0, 19, 20), (65, 89, 35, 59, 25)]


def test_edges(spark, edges, nothing):
    text = prose(8, 60)
    items = spark.createDataFrame([(1, text, "", ""), (1, text, "", ""), (2, None, "", ""), (3, "", "", ""), (4, "no id here at all", "", ""), (5, "one", "", ""), (None, text, "", "")], ITEMS)
    got = contaminations(edges, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(8, 1), (9, 1), (8, None), (9, None), (None, 4)} and len(got) == 5
    kept = clean_documents(edges, items)
    assert kept.columns == edges.columns and kept.count() == len(EDGES) - 3  # 8, 9 and one of the two rows without id
    assert contaminations(nothing, items).count() == 0 and contaminations(edges, items.limit(0)).count() == 0
    assert clean_documents(edges, items.limit(0)).count() == len(EDGES)


def test_recall_with_substitutions(spark):
    """Overlaps that fulfil what the docstring states, with substitutions at random places of the item."""
    rng, docs, items = random.Random(11), [], []
    for n, changes in ((12, 1), (13, 2), (15, 3), (20, 4), (30, 6)):
        for _ in range(60):
            i = len(docs)
            item = prose(10_000 + i, n).split()
            changed = list(item)
            for k in rng.sample(range(n), changes):
                changed[k] = f"x{k}"
            docs.append((i, f"{prose(20_000 + i, 40)} {' '.join(changed)} {prose(30_000 + i, 40)}"))
            items.append((i, " ".join(item), "", ""))
    got = {(r.doc_id, r.item_id) for r in contaminations(spark.createDataFrame(rows(docs), DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got <= {(i, i) for i in range(300)}
    assert all(sum((i, i) in got for i in range(60 * g, 60 * g + 60)) >= 57 for g in range(5))


def test_rows_are_judged_one_by_one(spark):
    item, clean = prose(70, 30), prose(71, 60)
    docs = [(None, item), (None, clean), (None, clean), (7, item), (7, clean), (8, item)]
    items = spark.createDataFrame([(1, item, "", "")], ITEMS)
    assert sorted((str(r.doc_id), r.text) for r in clean_documents(spark.createDataFrame(rows(docs), DOCS), items).collect()) == [("7", clean), ("None", clean), ("None", clean)]
