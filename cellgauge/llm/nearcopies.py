"""Groups of near copies: bit-sliced SimHash comparison, then sketches, inside buckets that decide on their own.

A text is known by its set of hashed word shingles, of which it carries three
short forms: a SimHash fingerprint, a few minima, and a sketch with the least
hash in each of 1,024 bins (whether a bin is used, and two bits of its least).
Texts with two equal minima share a bucket. In a bucket all pairs whose
fingerprints lie within a wide radius are found bit-sliced, 64 at a time, and
those whose sketches agree in a share of at least ``similarity - margin`` of
the bins that either uses are linked. What leaves a bucket is a forest of its
links, at most one row per member, so rows never grow with the pairs; no text
is fetched again.

The share is an estimate of the Jaccard similarity, exact but for bins where
shingles meet; for long texts its deviation is 0.013 at a similarity of 0.8.
``margin`` weighs pairs lost just above the similarity against pairs linked
just below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.components import components
from cellgauge.llm.simhash import close_pairs, forest, majority
from cellgauge.llm.text import Texts, gram_hash, ids, id_array, mix, span_hash
from cellgauge.session import stage

BITS = 10
BINS = 1 << BITS
#: bits of a value; with those of a bin they leave room for the number of a text
VALUE = 42
#: bytes of a sketch: the used bins, then the low and the high bit of their values
SKETCH = BINS // 8 * 3
#: texts whose sketches are made together, and pairs whose sketches are fetched together
TEXTS, PAIRS = 2048, 1 << 12
#: members of a bucket that all others are compared with before all meet all
LEADERS = 8


def shingle_hashes(part: Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in order, and how many each has; a shorter text is one shingle."""
    low = part.folded()
    starts, ends, first = low.tokens()
    words, n = span_hash(low.prefix(), starts, ends), np.diff(first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    total = np.cumsum(count)
    at = np.arange(int(count.sum())) + np.repeat(first[:-1] - (total - count), count)
    size = np.repeat(np.minimum(n, shingle), count)
    out = np.zeros(len(at), np.uint64)
    for k in range(1, shingle + 1):
        some = np.flatnonzero(size == k)
        if len(some):
            out[some] = gram_hash(words, k)[at[some]] ^ np.uint64(k)
    return mix(out), count


def sketches(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One row of ``SKETCH`` bytes per text."""
    out = np.zeros((len(count), 3, BINS), bool)
    ends = np.cumsum(count)
    for lo in range(0, len(count), TEXTS):
        hi = min(len(count), lo + TEXTS)
        part = mix(h[ends[lo] - count[lo]: ends[hi - 1]] ^ np.uint64(0x5851F42D4C957F2D))
        text = np.repeat(np.arange(hi - lo, dtype=np.uint64), count[lo:hi])
        # text, bin and value in one number: the first of each text and bin has the least value
        key = np.sort(text << np.uint64(VALUE + BITS) | (part & np.uint64(BINS - 1)) << np.uint64(VALUE) | part >> np.uint64(64 - VALUE))
        cell = key >> np.uint64(VALUE)
        key, cell = (a[np.concatenate(([True], cell[1:] != cell[:-1]))[: len(cell)]] for a in (key, cell))
        row, bin_of = (cell >> np.uint64(BITS)).astype(np.int64) + lo, (cell & np.uint64(BINS - 1)).astype(np.int64)
        out[row, 0, bin_of] = True
        out[row, 1, bin_of], out[row, 2, bin_of] = key & np.uint64(1), key >> np.uint64(1) & np.uint64(1)
    return np.packbits(out.reshape(len(count), 3 * BINS), axis=1)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of sketches (as 64-bit words); a different value goes unnoticed once in four times."""
    w = BINS // 64
    used = np.bitwise_count(a[:, :w] | b[:, :w]).sum(axis=1, dtype=np.int64)
    apart = np.bitwise_count((a[:, :w] ^ b[:, :w]) | (a[:, w: 2 * w] ^ b[:, w: 2 * w]) | (a[:, 2 * w:] ^ b[:, 2 * w:])).sum(axis=1, dtype=np.int64)
    lone = np.bitwise_count(a[:, :w] ^ b[:, :w]).sum(axis=1, dtype=np.int64)
    return 1 - (lone + (apart - lone) / 0.75) / np.maximum(used, 1)


def _agree(marks: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows agree in ``least`` or more; few at a time, since two sketches take far more room than their positions."""
    same = np.zeros(len(a), bool)
    for at in range(0, len(a), PAIRS):
        part = slice(at, at + PAIRS)
        same[part] = agreement(marks[a[part]], marks[b[part]]) >= least
    return same


def _describe(shingle: int, minima: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, least, marks, total = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)]
            for _, part in Texts.of(batch.column("_text")).chunks(1 << 20):
                h, count = shingle_hashes(part, shingle)
                fps.append(majority(h, count))
                rows, some = np.zeros((len(count), minima), np.uint64), np.flatnonzero(count)
                for k in range(minima if len(some) else 0):
                    rows[some, k] = np.minimum.reduceat(mix(h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), (np.cumsum(count) - count)[some])
                least.append(rows.ravel())
                marks += [row.tobytes() for row in sketches(h, count)]
                total.append(count)
            least = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * minima, pa.int32()), pa.array(np.concatenate(least).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [id_array(ids(batch.column("_id"))), pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(total)), least, pa.array(marks, pa.binary()), batch.column("digest")],
                ["_id", "fp", "n", "minima", "sketch", "digest"])

    return run


def _linked(fp: np.ndarray, key: np.ndarray, marks: np.ndarray, radius: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs, enough of them to hold together what all links hold together. ``key`` is sorted."""
    cuts = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
    joined = np.arange(len(key))
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo <= 4 * LEADERS:
            continue
        # large groups hang on a few texts: whoever is linked to one of them needs no comparison with the others of it
        for _ in range(LEADERS):
            loose = lo + np.flatnonzero(joined[lo:hi] == np.arange(lo, hi))
            if len(loose) < 2:
                break
            lead, rest = loose[0], loose[1:]
            near = rest[np.bitwise_count(fp[rest] ^ fp[lead]) <= radius]
            near = near[_agree(marks, np.full(len(near), lead), near, least)]
            joined[near] = lead
            if len(near):
                yield np.full(len(near), lead), near
            joined[lead] = lead if len(near) else -lead - 1  # a leader without a group leads no more
    joined = np.where(joined < 0, -joined - 1, joined)
    for i, j in close_pairs(fp, key, radius):
        open_ = joined[i] != joined[j]
        i, j = i[open_], j[open_]
        same = _agree(marks, i, j, least)
        if same.any():
            yield i[same], j[same]


def _buckets(radius: int, least: float):
    """For each run of whole buckets a forest of the links in it."""

    def links(key: np.ndarray, fp: np.ndarray, vertex: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((vertex, key))
        key, fp, vertex, marks = key[order], fp[order], vertex[order], marks[order]
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in _linked(fp, key, marks, radius, least):
            # kept as a forest all the time, by positions: a text stands in a bucket once
            a, b = forest(np.concatenate((a, i)), np.concatenate((b, j)))
        return pa.RecordBatch.from_arrays([pa.array(vertex[a], pa.int64()), pa.array(vertex[b], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros((0, SKETCH // 8), np.uint64)]
        for batch in batches:
            marks = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 8)
            rows = [np.concatenate((h, c)) for h, c in zip(held, [*(batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "fp", "vertex")), marks])]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last bucket may go on
            held = [r[cut:] for r in rows]
            if cut:
                yield links(rows[0][:cut], rows[1][:cut].view(np.uint64), rows[2][:cut], rows[3][:cut])
        if len(held[0]):
            yield links(held[0], held[1].copy().view(np.uint64), *held[2:])

    return run


def _groups(docs: DataFrame, similarity: float, margin: float, radius: int, shingle: int, minima: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """All rows (_id, digest), and all texts (digest, vertex, component)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), body.alias("_text"), F.md5(body).alias("digest"))
    made = rows.mapInArrow(_describe(shingle, minima), "_id bigint, fp bigint, n bigint, minima array<bigint>, sketch binary, digest string")
    hashed = stage(made, "sketches")
    nameless = F.xxhash64("digest").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    firsts = hashed.groupBy("digest").agg(F.min("_id").alias("_least"), *(F.first(c).alias(c) for c in ("fp", "n", "minima", "sketch")))
    # an id on rows of several texts can name one of them only
    owner = firsts.filter("_least is not null").groupBy(F.col("_least").alias("_own")).agg(F.min("digest").alias("_by"))
    texts = firsts.join(owner, F.col("_least") == F.col("_own"), "left").withColumn("vertex", F.when(F.col("_by") == F.col("digest"), F.col("_least")).otherwise(nameless))
    texts = stage(texts.select("digest", "vertex", "fp", "n", "minima", "sketch"), "texts")
    keys = F.array(*(F.xxhash64(F.lit(i), F.lit(j), F.col("minima")[i], F.col("minima")[j]) for i, j in combinations(range(minima), 2)))
    lanes = texts.filter("n > 0").select("fp", "vertex", "sketch", F.explode(keys).alias("key"))
    # most buckets hold one text: they needn't be carried
    shared = lanes.groupBy("key").agg(F.count("*").alias("_m")).filter("_m > 1").select("key")
    met = lanes.join(shared, "key").repartition("key").sortWithinPartitions("key").select("key", "fp", "vertex", "sketch")
    stars = components(met.mapInArrow(_buckets(radius, similarity - margin), "a bigint, b bigint"))
    named = texts.select("digest", "vertex").join(stars, F.col("vertex") == F.col("member"), "left").select("digest", "vertex", F.coalesce("component", "vertex").alias("component"))
    return hashed.select("_id", "digest"), named


def near_copies(
    docs: DataFrame, similarity: float = 0.8, margin: float = 0.015, radius: int = 22, shingle: int = 5, minima: int = 6, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each row with the digest of its text and the component, the least vertex of its group of copies and near copies: ``id, digest, vertex, component``.

    Texts are linked when two of their ``minima`` minima agree (at a similarity
    of 0.8 all but 2 in 1,000 do), their fingerprints differ in ``radius`` bits
    at most (10 on average there), and their sketches agree in a share of at
    least ``similarity - margin``. Groups are the components of these links.

    Copies of a text are one vertex, named by its least id, or by its digest
    where no copy has an id. Null texts count as empty; texts without words are
    copies of each other only if equal. Ids are below 2^62.
    """
    rows, texts = _groups(docs, similarity, margin, radius, shingle, minima, id_col, text)
    return rows.join(texts, "digest").select(F.col("_id").alias(id_col), "digest", "vertex", "component")


def one_of_each(
    docs: DataFrame, similarity: float = 0.8, margin: float = 0.015, radius: int = 22, shingle: int = 5, minima: int = 6, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of ``near_copies``: a copy of its first text, that of the least id.

    Of rows that agree in id and text (rows without id too) one stays, with the
    least of its other columns.
    """
    rows, texts = _groups(docs, similarity, margin, radius, shingle, minima, id_col, text)
    # copies are counted before they meet anything: a third of all rows may have one digest
    lead = rows.groupBy("digest", "_id").agg(F.count("*").alias("_rows")).groupBy("digest").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_rows")).alias("_l"))
    lead = lead.join(texts.filter("vertex = component"), "digest", "left_semi").select(F.col("digest").alias("_digest"), "_l._id", "_l._rows")
    lead = stage(lead, "kept")
    same = (F.md5(F.coalesce(docs[text], F.lit(""))) == lead["_digest"]) & docs[id_col].cast("long").eqNullSafe(lead["_id"])
    row = F.struct(*(docs[c] for c in docs.columns)).alias("_row")
    kept = docs.join(lead, same).select(row, lead["_digest"].alias("_by"), lead["_rows"].alias("_n"))
    several = kept.filter("_n > 1").groupBy("_by").agg(F.min("_row").alias("_row"))
    return kept.filter("_n = 1").select("_row.*").unionByName(several.select("_row.*"))
