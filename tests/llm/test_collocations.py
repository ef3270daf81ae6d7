import random
import re
from collections import Counter

import pytest

from cellgauge.llm.collocations import collocations, frequent_phrases

DOCS = "doc_id long, text string, lang string, phrase string, key string, _lang string, shard string, f long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "p", "k", "l", "s", 1) for i, (t, g) in enumerate(rows)], DOCS)


def counted(rows, longest=4):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i: i + n])] += 1
    return f, total


def brute(rows, threshold=30, limit=2000):
    f, total = counted(rows)
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= threshold}
    found = []
    for (lang, p), a in cand.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i: i + len(p)] == p for i in range(len(q))) for (g, q), b in cand.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.append((lang, -score, -a, " ".join(p).encode(), l, r))
    found.sort()
    rank, out = Counter(), []
    for lang, s, a, p, l, r in found:
        rank[lang] += 1
        if rank[lang] <= limit:
            out.append((lang, rank[lang], p.decode(), -a, l, r, total[lang], -s))
    return out


def prose(seed, docs=60, vocabulary=14):
    """Few words in runs, so that phrases of all lengths are frequent."""
    rng = random.Random(seed)
    fixed = ["New York City hall", "as soon as", "of the", "é à", "x  y\tz"]
    rows = []
    for _ in range(docs):
        text = ""
        for _ in range(rng.randrange(80)):
            text += rng.choice(fixed) if rng.random() < 0.3 else f"{rng.choice('abAB')}{rng.randrange(vocabulary)}"
            text += rng.choice([" ", " ", " ", "  ", ". ", ",", "\n", "\t", "?!"])
        rows.append((text, rng.choice(["en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("seed,shards,bits", [(1, 3, 22), (2, 1, 22), (3, 5, 4)])
def test_equals_brute_force(spark, seed, shards, bits):
    # 4 bits: most parts share a slot, counts must not change
    rows = prose(seed) + [(None, "en"), ("", None), (" .,\n", "de"), ("of the " * 3000, "en"), *[("as soon as possible", "fr")] * 40]
    got = [tuple(r) for r in collocations(table(spark, rows).repartition(7), threshold=4, shards=shards, bits=bits).orderBy("lang", "rank").collect()]
    assert len(got) > 40 and got == brute(rows, 4)


def test_counts_are_exact(spark):
    rows = prose(4)
    f, total = counted(rows)
    got = {(r.lang, r.phrase): r.f for r in frequent_phrases(table(spark, rows), 5).collect() if r.length}
    assert got == {(g, " ".join(p)): a for (g, p), a in f.items() if a >= 5}


def test_limit_and_nothing(spark):
    rows = prose(5)
    got = [tuple(r) for r in collocations(table(spark, rows), threshold=8, limit=3).orderBy("lang", "rank").collect()]
    assert got == brute(rows, 8, 3)
    assert collocations(table(spark, rows), threshold=10**6).count() == 0
    assert collocations(table(spark, [(None, None)]).filter("doc_id < 0")).count() == 0
