import random
import re

from cellgauge.llm.catalog import queries
from cellgauge.llm.licences import PHRASES, TEMPLATES, Automaton, license_scan, split_words
from tests.conftest import SF
from tests.llm.conftest import DOCS, EDGES, rows

FOLD = {i: i + 32 for i in range(65, 91)}


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i: i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def told(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_query_equals_brute_force(spark, corpus):
    _, texts = corpus
    got = queries()["op4_license_scan"](spark, SF).collect()
    assert {r.doc_id: told(r) for r in got} == {d: base(t) for d, t in texts.items()} and len(got) == len(texts)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)


def test_matching_statistics():
    rng = random.Random(3)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(6)]
    machine = Automaton(sequences)
    text = [rng.randrange(4) for _ in range(200)]
    for i, (state, length) in enumerate(machine.walk(text)):
        held = [n for n in range(i + 2) if any(s[a: a + n] == text[i + 1 - n: i + 1] for s in sequences for a in range(len(s) - n + 1))]
        assert length == max(held)
        ends = {(k, e) for k, s in enumerate(sequences) for e in range(length, len(s) + 1) if length and s[e - length: e] == text[i + 1 - length: i + 1]}
        assert ends <= set(machine.ends[state]) if length else state == 0


def test_templates_are_found_whole_changed_and_in_parts(spark):
    label, text = TEMPLATES[0]
    w = [x.decode() for x in split_words(text)]
    changed = [x if i % 23 else "something" for i, x in enumerate(w)]
    docs = [(1, "before " + text.upper() + " after"), (2, " ".join(changed)), (3, " ".join(w[: len(w) // 3])), (4, " ".join(reversed(w))), (5, "the rights of the copyright notice and this permission")]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows(docs), DOCS)).collect()}
    assert got[1].labels == label and got[1].score == 1 and got[1].spans[0].first == 1 and got[1].spans[0].last == len(w)
    assert got[2].labels == label and got[2].score < 1
    assert got[3].labels == got[4].labels == got[5].labels == "" and 0.2 < got[3].score < 0.5


def test_every_template_alone_is_found(spark):
    docs = [(i, t) for i, (_, t) in enumerate(TEMPLATES)] + [(100 + i, f"before it: {t}. Then more") for i, (_, t) in enumerate(TEMPLATES)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows(docs), DOCS)).collect()}
    for i, (label, text) in enumerate(TEMPLATES):
        for r, at in ((got[i], 0), (got[100 + i], 2)):
            assert r.score == 1 and label in r.labels.split(",")
            assert (label, at, at + len(split_words(text)) - 1, 1.0) in [(s.label, s.first, s.last, s.score) for s in r.spans]


def test_edges(edges, nothing):
    got = license_scan(edges).collect()
    assert sorted(map(str, ((r.doc_id, told(r)) for r in got))) == sorted(str((d, base(t))) for d, t in EDGES)
    assert license_scan(nothing).count() == 0
