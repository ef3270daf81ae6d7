import math
import random
import re
from collections import Counter

import numpy as np

from cellgauge.llm.catalog import queries
from cellgauge.llm.quality import good_documents, quality_rules
from tests.conftest import SF
from tests.llm.conftest import EDGES


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i: i + 5]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def told(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_query_equals_brute_force(spark, corpus):
    _, texts = corpus
    got = queries()["op7_quality_rules"](spark, SF).collect()
    assert {r.doc_id: told(r) for r in got} == {d: base(t) for d, t in texts.items()} and len(got) == len(texts)
    assert not any(r.kept and r.base_failed for r in got)


def test_ratio_separates_held_out_labels(spark, sf="/root/testdata/sf0.01"):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trusted = labels.filter("quality = 1 and toxic = 0 and doc_id % 2 = 0").select("doc_id")
    scored = quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), trusted).filter("not base_failed")
    held = scored.join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r.kept for r in held if r.quality == 1], [r.kept for r in held if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.4


def multinomial(texts, trusted, buckets, quantile):
    """Scores and the floor, counted plainly over words and word pairs."""
    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return Counter(words) + Counter(zip(words, words[1:], strict=False))

    raw, good = Counter(), Counter()
    for d, text in texts:
        raw += grams(text)
        good += grams(text) if d in trusted else Counter()

    def score(text, own):
        mine = grams(text)
        gone = mine if own else Counter()
        r, g = raw.total() - gone.total() + buckets, good.total() - gone.total() + buckets
        each = [c * (math.log((good[k] - gone[k] + 1) / g) - math.log((raw[k] - gone[k] + 1) / r)) for k, c in mine.items()]
        return sum(each) / max(1, mine.total())

    floor = np.quantile([score(t, True) for d, t in texts if d in trusted and not base(t)[-1]], quantile)
    return [score(t, False) for _, t in texts], floor


def test_score_and_kept_equal_a_plain_count(spark):
    rng = random.Random(5)
    words = "Ein zwei drei vier fünf sechs SIEBEN acht neun zehn elf zwölf".split()
    texts = []
    for d in range(80):
        liked = words[:7] if d % 4 == 0 else words
        texts.append((d, " ".join(rng.choices(liked, k=rng.choice((4, 12, 40))))))
    texts += [(0, texts[0][1]), (200, "")]
    trusted, buckets = {d for d in range(0, 40, 4)}, 1 << 20
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(d,) for d in trusted], "doc_id long")
    for quantile in (0.001, 0.3):
        scores, floor = multinomial(texts, trusted, buckets, quantile)
        got = sorted((r.doc_id, round(r.score, 9), r.kept) for r in quality_rules(docs, marks, buckets, quantile=quantile).collect())
        assert got == sorted((d, round(s, 9), not base(t)[-1] and s >= floor) for (d, t), s in zip(texts, scores, strict=True))
        assert 0 < sum(k for *_, k in got) < len(got)
        assert good_documents(docs, marks, buckets, quantile=quantile).count() == sum(k for *_, k in got)


def test_edges(spark, edges, nothing):
    trusted = spark.createDataFrame([(7,), (None,), (12345,), (7,)], "doc_id long")
    got = quality_rules(edges, trusted).collect()
    assert sorted(map(str, ((r.doc_id, told(r)) for r in got))) == sorted(str((d, base(t))) for d, t in EDGES)
    none = trusted.limit(0)
    assert {r.score for r in quality_rules(edges, none).collect()} == {0.0}
    kept = good_documents(edges, none)
    assert kept.columns == edges.columns and sorted(r.doc_id for r in kept.collect()) == [7, 8, 9]
    assert quality_rules(nothing, none).count() == 0 and good_documents(nothing, trusted).count() == 0
