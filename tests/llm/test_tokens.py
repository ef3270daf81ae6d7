import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cellgauge.llm.catalog import queries
from cellgauge.llm import tokens
from cellgauge.llm.tokens import CACHE, missing_texts, token_counts
from tests.conftest import SF
from tests.llm.conftest import EDGES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_query_equals_library(spark, corpus):
    _, texts = corpus
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = {d: (len(t.encode()), n := len(model.encode(t)), n > 4096) for d, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries()["op2_token_counts"](spark, SF).collect()} == expected


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_edges(edges, nothing, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(edges, path).collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), count(t or "")) for d, t in EDGES), key=str)
    assert token_counts(nothing, path).count() == 0


def test_cache_encodes_only_what_it_misses(spark, corpus, tmp_path):
    docs, texts = corpus
    cache = str(tmp_path / "cache")
    first = {r.doc_id: r.n_tokens for r in token_counts(docs.filter("doc_id < 50"), MODEL, cache).collect()}
    stored = spark.read.schema(CACHE).parquet(cache)
    assert stored.count() == len({t for d, t in texts.items() if d < 50})
    # what the cache says is taken, so a text isn't encoded twice
    stored.selectExpr("tokenizer", "digest", "n_bytes", "n_tokens + 1000 as n_tokens").write.parquet(str(tmp_path / "other"))
    again = {r.doc_id: r.n_tokens for r in token_counts(docs, MODEL, str(tmp_path / "other")).collect()}
    assert all(again[d] == n + 1000 for d, n in first.items()) and len(again) == len(texts)
    # counts of another tokenizer say nothing
    assert token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), cache).count() == len(texts)


def test_texts_stay_in_place_when_few_are_missing(spark, corpus, tmp_path, monkeypatch):
    docs, texts = corpus
    kept = dict(list(texts.items())[:3])
    missing = docs.filter(docs.doc_id.isin(*kept)).selectExpr("sha2(text, 256) AS _digest", "doc_id AS _id")
    few, many = (missing_texts(docs, missing, rare, "doc_id", "text") for rare in (True, False))
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (few, many)]
    assert ["hashpartitioning" in p for p in plans] == [False, True]
    assert sorted(r._text for r in few.collect()) == sorted(r._text for r in many.collect()) == sorted(kept.values())
    # both ways, and a cache that lacks nothing, give the same counts
    cache = str(tmp_path / "cache")
    first = sorted(map(tuple, token_counts(docs, MODEL, cache).collect()))
    before = spark.read.schema(CACHE).parquet(cache).count()
    assert sorted(map(tuple, token_counts(docs, MODEL, cache).collect())) == first and spark.read.schema(CACHE).parquet(cache).count() == before
    monkeypatch.setattr(tokens, "FEW", 1.0)
    assert sorted(map(tuple, token_counts(docs, MODEL).collect())) == first
