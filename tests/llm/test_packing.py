import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cellgauge.llm.catalog import queries
from cellgauge.llm.packing import Encoder, best_fit, pack_documents
from cellgauge.llm.text import Texts
from tests.conftest import SF
from tests.llm.conftest import EDGES

FILE = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Sequences that best fit opens when it takes one piece after the other, longest first."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(capacity - n)
    return sorted(free)


def unrolled(matches):
    """(sequence, offset, length) of each piece."""
    return [(s + i // k, o + i % k * n, n) for n, _, count, k, s, o in matches.tolist() for i in range(count)]


def checked(pieces, capacity):
    """Asserts that every sequence is gapless from 0 and not too long; returns the free tokens of each."""
    by = defaultdict(list)
    for s, o, n in pieces:
        by[s].append((o, n))
    for parts in by.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
    return sorted(capacity - sum(n for _, n in parts) for parts in by.values())


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 40, 256])
    lengths = [min(capacity, 1 + int(rng.paretovariate(rng.choice([0.4, 1, 3])))) for _ in range(rng.choice([0, 1, 30, 400]))]
    matches = best_fit(Counter(lengths), capacity)
    assert checked(unrolled(matches), capacity) == one_by_one(lengths, capacity)
    assert sorted(n for _, _, n in unrolled(matches)) == sorted(lengths)


def test_matches_do_not_grow_with_the_documents():
    rng = random.Random(5)
    shape = Counter(min(4096, 1 + int(rng.lognormvariate(6, 1.3))) for _ in range(40_000))
    few, many = best_fit(shape, 4096), best_fit({n: 1_000_003 * c for n, c in shape.items()}, 4096)
    assert len(many) < 30_000 and len(many) < 3 * len(few)


def expected(rows, capacity=4096):
    model, out = Tokenizer.from_file(FILE), []
    for i, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(i, p, s, len(ids[s: s + capacity]), zlib.crc32(ids[s: s + capacity].tobytes())) for p, s in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    return sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str), [(r.sequence_id, r.offset, r.length) for r in rows]


def test_query(spark, corpus):
    pieces, places = got(queries()["op13_pack"](spark, SF))
    assert pieces == expected(corpus[1].items())
    free = checked(places, 4096)
    assert free == one_by_one([p[3] for p in pieces], 4096)
    assert len(free) == -(-sum(p[3] for p in pieces) // 4096)  # fewer is impossible


def test_edges(edges, nothing):
    pieces, places = got(pack_documents(edges, FILE, 64))
    assert pieces == expected(EDGES, 64)
    checked(places, 64)
    assert pack_documents(nothing, FILE).count() == 0


def test_words_alone_give_the_same_ids():
    odd = ["", "  ", "a\u0301 e \u0301x", "ΑΣ Σ ΣΑ'S it's don't 's '", "<|endoftext|>a <|startoftext|> <|endof text|>", "12 3４ ½ x\u00a0y\u2003z \x1c\x85 ﬁ İI ǅ", "\u0308 \U0001F600\U0001F600 日本 語\r\n\v\f\tend", "x" * 5000, "A\0B \0 C\0\0", "AB ab Ab <|ENDOFTEXT|> É é", "a. b.. c'.. d'. e.' f,g. 5%! é. .x. x.y. ... .' a.<|endoftext|>. x.\u0301 y.é", "it's. 's. don't!? e-mail's-,"]
    model, encode = Tokenizer.from_file(FILE), Encoder(FILE, 1)
    for texts in (odd, odd[::-1], [t + " " + u for t in odd for u in odd]):
        ids, at = encode(Texts.of(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*model.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert encode.by_word and len(encode.known)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_vocabularies_take_whole_texts(name):
    path = public_tokenizers.path(name)
    model, encode = Tokenizer.from_file(path), Encoder(path, 1)
    texts = ["two  words\n", "", " x y"]
    ids, at = encode(Texts.of(pa.array(texts)))
    assert not encode.by_word and [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*model.encode(t, add_special_tokens=False).ids, 1] for t in texts]
