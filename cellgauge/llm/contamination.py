"""Benchmark decontamination by spaced seeds.

A mask selects some of a few consecutive words; the hash of the selected words
is the same whatever stands at the others, so a substituted word doesn't hide
an overlap. Hashes of the test items and of the documents meet in a join; each
meeting names a diagonal, along which the words are then compared, and a
stretch is reported that is long enough with few enough substitutions.

Documents are read once. A filter of fixed size, made from the test hashes,
drops nearly all document hashes before the join; it may let too many pass,
never too few, so results don't depend on its size. Only the neighbourhood of
a hit travels on, not the document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.stretches import by_agreement
from cellgauge.llm.text import OPAQUE, Texts, id_array, ids, inside, mix, span_hash
from cellgauge.session import stage

#: 1: the word counts, 0: any word may stand there
MASKS = ("1101101", "1011011", "1110011")
FILTER_BITS = 23
PROBES = 3


def _words(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    low = part.folded_latin()
    starts, ends, first = low.tokens(OPAQUE)
    return span_hash(low.prefix(), starts, ends), first


def _seeds(words: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every place of the mask inside a text."""
    at = np.flatnonzero(inside(first, len(mask), len(words)))
    h = np.full(len(at), int(mask, 2) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
    return h, at


def _item_seeds(masks: Sequence[str], shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = ids(batch.column("_item"))
            for k, part in Texts.of(batch.column("_text")).chunks():
                words, first = _words(part)
                n = np.diff(first)
                for mask in (*masks, *("1" * m for m in range(shortest, len(masks[0])))):
                    h, at = _seeds(words, first, mask)
                    of = np.searchsorted(first, at, side="right") - 1
                    if mask not in masks:  # for items that no mask fits into
                        whole = n[of] == len(mask)
                        h, at, of = h[whole], at[whole], of[whole]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), id_array(item[k + of]), pa.array(at - first[of])], ["h", "item", "at"])

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, first = _words(Texts.of(batch.column("_text")))
        yield pa.RecordBatch.from_arrays([batch.column("_item"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(words.view(np.int64)))], ["item", "item_words"])


def _hits(masks: Sequence[str], known: np.ndarray, bits: int, reach: int):
    size = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = ids(batch.column("_id")), batch.column("_tag")
            for k, part in Texts.of(batch.column("_text")).chunks():
                words, first = _words(part)
                found_h, found_at = [], []
                for mask in masks:
                    h, at = _seeds(words, first, mask)
                    for turn in range(PROBES):
                        slot = h >> np.uint64(turn * 20) & size
                        ok = known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1) > 0
                        h, at = h[ok], at[ok]
                    found_h.append(h)
                    found_at.append(at)
                h, at = np.concatenate(found_h), np.concatenate(found_at)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                h, at = h[order], at[order]
                of = np.searchsorted(first, at, side="right") - 1
                # hits that lie within reach of each other share one stretch of words
                new = np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] - at[:-1] > 2 * reach)))
                cut = np.append(np.flatnonzero(new), len(at))
                top, low = cut[:-1], cut[1:] - 1
                begin = np.maximum(at[top] - reach, first[of[top]])
                end = np.minimum(at[low] + reach, first[of[top] + 1])
                yield pa.RecordBatch.from_arrays(
                    [id_array(doc[k + of[top]]), tag.take(pa.array(k + of[top])), pa.array(begin - first[of[top]]),
                     pa.array([words[a:b].view(np.int64) for a, b in zip(begin, end)], pa.list_(pa.int64())),
                     pa.array([h[a:b].view(np.int64) for a, b in zip(cut, cut[1:])], pa.list_(pa.int64())),
                     pa.array([at[a:b] - begin[i] for i, (a, b) in enumerate(zip(cut, cut[1:]))], pa.list_(pa.int64()))],
                    ["_id", "tag", "begin", "words", "hits", "places"],
                )

    return run


def overlaps(doc: np.ndarray, item: np.ndarray, diagonal: int, max_substituted: float, least: float) -> Iterator[tuple[int, int, int]]:
    """Disjoint stretches where item word i meets document word i + diagonal: first and last item word, words that agree.

    ``least`` words or more agree in each, and at most the share ``max_substituted`` don't.
    """
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if high > low:
        same = doc[low + diagonal: high + diagonal] == item[low:high]
        for a, b in by_agreement(same, least, max_substituted):
            yield low + a, low + b - 1, int(same[a:b].sum())


def _verify(min_words: int, max_substituted: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(len(batch)):
                doc, item = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("words", "item_words"))
                diagonal = batch.column("diagonal")[k].as_py()
                at = batch.column("begin")[k].as_py() + diagonal
                for first, last, same in overlaps(doc, item, diagonal, max_substituted, min(min_words, (1 - max_substituted) * len(item))):
                    rows.append((batch.column("_id")[k].as_py(), batch.column("tag")[k].as_py(), batch.column("item")[k].as_py(), at + first, at + last, first, last, same))
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_id", "tag", "item", "first_word", "last_word", "item_first", "item_last", "n_same"])

    return run


def _found(docs: DataFrame, items: DataFrame, masks: Sequence[str] = MASKS, min_words: int = 10, max_substituted: float = 0.2, shortest: int = 4, filter_bits: int = FILTER_BITS,
                   id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The overlaps of ``contaminations`` with the hash of each text."""
    items = items.select(F.col(item_id).cast("long").alias("_item"), F.col(item_text).alias("_text"))
    seeds = stage(items.mapInArrow(_item_seeds(masks, shortest), "h bigint, item bigint, at bigint"), "item-seeds")
    item_words = stage(items.mapInArrow(_item_words, "item bigint, item_words array<bigint>").distinct(), "item-words")
    slots = F.array(*(F.shiftrightunsigned("h", 20 * turn).bitwiseAND((1 << filter_bits) - 1) for turn in range(PROBES)))
    set_bits = seeds.select(F.explode(slots).alias("slot")).selectExpr("slot >> 6 as w", "shiftleft(1L, cast(slot & 63 as int)) as bit")
    known = np.zeros(1 << filter_bits - 6, np.uint64)  # at most so many rows arrive
    for row in set_bits.groupBy("w").agg(F.bit_or("bit").alias("bits")).collect():
        known[row.w] = np.uint64(row.bits & 0xFFFFFFFFFFFFFFFF)
    longest = item_words.agg(F.max(F.size("item_words"))).first()[0] or 0
    short = item_words.select(F.size("item_words").alias("n")).filter(F.col("n").between(shortest, len(masks[0]) - 1)).distinct()
    every = (*masks, *("1" * row.n for row in short.collect()))  # a few lengths
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_tag"))
    schema = "_id bigint, tag bigint, begin bigint, words array<bigint>, hits array<bigint>, places array<bigint>"
    near = stage(rows.mapInArrow(_hits(every, known, filter_bits, longest + len(masks[0])), schema), "hits")
    key = ["_id", "tag", "begin"]
    met = near.select(*key, F.explode(F.arrays_zip("hits", "places")).alias("hit")).select(*key, F.col("hit.hits").alias("h"), F.col("hit.places").alias("place"))
    met = met.join(seeds, "h").select(*key, "item", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    stretch = near.select(F.col("_id").alias("i"), F.col("tag").alias("t"), F.col("begin").alias("b"), "words")
    same = met["_id"].eqNullSafe(stretch["i"]) & (met["tag"] == stretch["t"]) & (met["begin"] == stretch["b"])
    pairs = met.join(stretch, same).drop("i", "t", "b")
    pairs = pairs.join(item_words, pairs["item"].eqNullSafe(item_words["item"])).drop(item_words["item"])
    found = pairs.mapInArrow(_verify(min_words, max_substituted), "_id bigint, tag bigint, item bigint, first_word bigint, last_word bigint, item_first bigint, item_last bigint, n_same bigint")
    return found.distinct()


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_id: str = "item_id", **settings) -> DataFrame:
    """Overlaps: document, item, first_word and last_word in the document, item_first and item_last in the item, n_same.

    Words are runs of digits, letters and non-ASCII characters, with A-Z and
    the accented capitals of Latin-1 in lower case. A stretch is reported where at least ``min_words`` words agree
    (or all of a shorter item but the share ``max_substituted``), with at most
    that share of substitutions, each of several on one diagonal. Items of fewer than ``shortest`` words are
    ignored, those shorter than a mask need one place without substitution.
    Null texts have no words; repeated rows report once; null ids stay null.
    """
    found = _found(docs, items, id_col=id_col, item_id=item_id, **settings).drop("tag").distinct()
    return found.withColumnsRenamed({"_id": id_col, "item": item_id})


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` without any overlap, each judged by its own text whatever other rows have its id or none."""
    dirty = _found(docs, items, id_col=id_col, text=text, **settings).select("_id", "tag").distinct()
    return docs.join(dirty, docs[id_col].cast("long").eqNullSafe(dirty["_id"]) & (F.xxhash64(docs[text]) == dirty["tag"]), "left_anti")
