"""Quality rules: fixed word rules, then a hashed n-gram likelihood ratio of every document.

Two multinomials over hashed word n-grams are counted: one over trusted
documents, one over the whole corpus. A document's score is the mean log ratio
of the two over its n-grams; documents below a threshold go. The threshold
is a low quantile of the scores the trusted documents have when their own
counts are left out, and is the same for every document.

Tasks add their n-grams into one array of ``buckets`` counts and return only
that, so what is shuffled and what reaches the driver is bounded by the number
of buckets, not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.text import SPACE, Texts, gram_hash, id_array, ids, inside, span_hash, sums

BUCKETS = 1 << 14
TRUSTED_ROWS = 20_000
QUANTILE = 0.001
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _grams(part: Texts, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and texts of all words and word pairs of a chunk, in lower case."""
    low = part.folded()
    starts, ends, first = low.tokens()
    words = span_hash(low.prefix(), starts, ends)
    for n in (1, 2):
        at = np.flatnonzero(inside(first, n, len(words)))
        yield (gram_hash(words, n)[at] % np.uint64(buckets)).astype(np.int64), np.searchsorted(first, at, side="right") - 1


def _count(buckets: int, trusted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            told = np.isin(ids(batch.column("_id")), trusted)
            for k, part in Texts.of(batch.column("_text")).chunks():
                for at, doc in _grams(part, buckets):
                    raw += np.bincount(at, minlength=buckets)
                    good += np.bincount(at[told[k + doc]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "trusted"])

    return run


def _tables(docs: DataFrame, trusted: DataFrame, buckets: int, trusted_rows: int, id_col: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Add-one counts of the corpus and of the trusted documents per bucket, and the trusted ids.

    ``trusted`` lists ids. If there are more than ``trusted_rows``, those first
    by a hash of the id are taken; the corpus is always counted whole. Nulls
    and ids that aren't in ``docs`` say nothing.
    """
    marks = trusted.select(F.col(id_col).cast("long").alias("_id")).filter("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(trusted_rows)
    chosen = np.array(sorted(row[0] for row in marks.collect()), np.int64)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    counted = rows.mapInArrow(_count(buckets, chosen), "bucket bigint, raw bigint, trusted bigint")
    raw, good = np.ones(buckets, np.int64), np.ones(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect():  # at most ``buckets`` rows
        raw[row.bucket] += row.raw
        good[row.bucket] += row.trusted
    return raw, good, chosen


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log(trusted share / corpus share) per bucket; all zero without trusted documents."""
    return np.log(good / good.sum()) - np.log(raw / raw.sum()) if good.sum() > len(good) else np.zeros(len(good))


def left_out_scores(part: Texts, raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The score each trusted text would have if it were in neither count: that of a clean text nobody labelled."""
    buckets = len(raw)
    keys = np.concatenate([doc * buckets + at for at, doc in _grams(part, buckets)])
    key, own = np.unique(keys, return_counts=True)
    doc, at = key // buckets, key % buckets
    grams = np.bincount(doc, own, len(part))
    ratio = np.log((good[at] - own) / (good.sum() - grams)[doc]) - np.log((raw[at] - own) / (raw.sum() - grams)[doc])
    return np.bincount(doc, own * ratio, len(part)) / np.maximum(grams, 1)


def _left_out(raw: np.ndarray, good: np.ndarray, trusted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.isin(ids(batch.column("_id")), trusted)
            for _, part in Texts.of(batch.column("_text").filter(pa.array(told))).chunks():
                values = _base(part)
                yield pa.RecordBatch.from_arrays([pa.array(left_out_scores(part, raw, good)[~failed(values)])], ["score"])

    return run


def fit(docs: DataFrame, trusted: DataFrame, buckets: int, trusted_rows: int, quantile: float, id_col: str, text: str) -> tuple[np.ndarray, float]:
    """Log ratios, and the least score to be kept.

    That is the given low quantile of the trusted documents' own scores, each
    with its own counts left out; those that fail the base rules have no say.
    One rule at every size; 0 where no trusted document says anything.
    """
    raw, good, chosen = _tables(docs, trusted, buckets, trusted_rows, id_col, text)
    if good.sum() == buckets:
        return np.zeros(buckets), 0.0
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    floor = rows.mapInArrow(_left_out(raw, good, chosen), "score double").agg(F.percentile("score", F.lit(quantile))).first()[0]  # at most the rows of the trusted ids
    return log_ratios(raw, good), 0.0 if floor is None else floor


def _same_before(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an equal key stands earlier, and whether one stands anywhere else, in the same text."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    equal = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    later, twice = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order[1:]] = equal
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    return later, twice


def _base(part: Texts) -> dict[str, np.ndarray]:
    starts, ends, first = part.tokens()
    prefix, n = part.prefix(), np.diff(first)
    solid = ~SPACE[part.buf]
    out = {"n_words": n, "word_chars": sums(solid & (part.buf & 0xC0 != 0x80), part.at), "n_symbols": sums(_SYMBOL[part.buf], part.at)}
    # lines: the bytes between line ends; only those with a word count
    feeds = np.flatnonzero(part.buf == 10)
    tops = np.union1d(part.at[:-1], feeds + 1)
    tops = tops[tops < part.at[-1]]
    lows = np.append(tops[1:], part.at[-1])
    ends_in_feed = part.buf[lows - 1] == 10 if len(tops) else np.zeros(0, bool)
    words_in = np.searchsorted(starts, lows) - np.searchsorted(starts, tops)
    line, owner = span_hash(prefix, tops, lows - ends_in_feed), part.owner(tops)
    told = words_in > 0
    later, _ = _same_before(line[told], owner[told])
    out["n_dup_lines"] = np.bincount(owner[told][later], minlength=len(part)).astype(np.int64)
    at = np.flatnonzero(inside(first, 5, len(starts)))
    windows = gram_hash(span_hash(prefix, starts, ends), 5)[at]
    _, twice = _same_before(windows, np.searchsorted(first, at, side="right") - 1)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    out["n_repeat_words"] = sums(np.cumsum(cover)[:-1] > 0, first)
    return out


def failed(values: dict[str, np.ndarray]) -> np.ndarray:
    """The base rules: fewer than 10 words, or more than a fifth of them in repeated windows."""
    return (values["n_words"] < 10) | (100 * values["n_repeat_words"] > 20 * values["n_words"])


def _score(ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            for _, part in Texts.of(batch.column("_text")).chunks():
                values = _base(part)
                total, grams = np.zeros(len(part)), np.zeros(len(part))
                for at, doc in _grams(part, len(ratios)):
                    total += np.bincount(doc, ratios[at], len(part))
                    grams += np.bincount(doc, minlength=len(part))
                values["score"] = total / np.maximum(grams, 1)
                for name, v in values.items():
                    found.setdefault(name, []).append(v)
            kinds = {"score": np.float64}
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")
            made = {k: np.concatenate(found[k]) if k in found else np.zeros(0) for k in names}
            columns = [id_array(ids(batch.column("_id"))), *(pa.array(made[k].astype(kinds.get(k, np.int64))) for k in names[:-1]), pa.array(failed(made).astype(bool)), pa.array(made["score"])]
            yield pa.RecordBatch.from_arrays(columns, ["_id", *names[:-1], "base_failed", "score"])

    return run


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS, threshold: float | None = None, quantile: float = QUANTILE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    ``score`` is the mean log ratio over words and word pairs (0 for a text
    without words); ``kept`` is false where a base rule fails or the score is
    below ``threshold`` (None: the ``quantile`` of the trusted documents'
    left-out scores, see ``fit``). Without trusted documents every score is 0.
    Null texts have no words, null ids stay null, repeated rows are judged each.
    """
    ratios, floor = fit(docs, trusted, buckets, trusted_rows, quantile, id_col, text)
    threshold = floor if threshold is None else threshold
    scored = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(_score(ratios), f"_id bigint, {BASE}, score double")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).withColumnRenamed("_id", id_col)


def good_documents(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS, threshold: float | None = None, quantile: float = QUANTILE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, dropped where they are read: nothing is shuffled."""
    ratios, floor = fit(docs, trusted, buckets, trusted_rows, quantile, id_col, text)
    score, threshold = _score(ratios), floor if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = next(score(iter([pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(text)], ["_id", "_text"])])))
            bad, found = (judged.column(c).to_numpy(zero_copy_only=False) for c in ("base_failed", "score"))
            yield batch.filter(pa.array(~bad.astype(bool) & (found >= threshold)))

    return docs.mapInArrow(run, docs.schema)
