"""Near duplicates by SimHash with bit-sliced comparison.

A fingerprint has a bit for the majority of the shingle hashes. Fingerprints
that may be close share a bucket. Inside a bucket they stand vertically: one
machine word holds the same bit of 64 fingerprints. A fingerprint is compared
with 64 others at once by adding the differing bits into counters that are
sliced the same way; they start so that they overflow just beyond the radius,
and a block is left as soon as all its 64 counters have.

Buckets. Within ``radius`` bits at least ``blocks - radius`` of the blocks of a
fingerprint agree, so every choice of that many blocks is a key: no pair is
missed. With 8 blocks and radius 2 a key fixes 48 bits: a bucket never holds
more than 65,536 different fingerprints, whatever the corpus. Equal
fingerprints meet in an aggregate before that. Radii too wide for this need
other keys (see ``nearcopies``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.components import components
from cellgauge.llm.text import Texts, id_array, ids, mix
from cellgauge.session import stage

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: BELOW[n] has the n lowest bits set
BELOW = np.array([(1 << n) - 1 for n in range(65)], dtype=np.uint64)
ITEMS = 1 << 16
#: pairs that are handed out together, about
HANDED = 1 << 18
NAMELESS = 1 << 62


def _shingle_hashes(part: Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of all shingles in order, and how many each text has."""
    import xxhash

    low = part.folded()
    starts, ends, first = low.tokens()
    size = ends - starts
    at = np.cumsum(size + 1) - size - 1  # words joined by one space each
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low.buf[_spans(starts, size)]
    n = np.diff(first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    begin = _spans(first[:-1], count)
    end = begin + np.repeat(np.minimum(n, shingle), count) - 1
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    h = np.array([digest(view[a:b], 42) for a, b in zip(at[begin].tolist(), (at + size)[end].tolist())], dtype=np.uint64)
    return h, count


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all spans one after another."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per text the bits that are set in over half of its hashes."""
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        tops = np.cumsum(count)[some] - count[some]
        for b in range(64):
            ones = np.add.reduceat(bits[:, b], tops, dtype=np.int64)
            out[some] |= (2 * ones > count[some]).astype(np.uint64) << np.uint64(b)
    return out


def _fingerprint(shingle: int, minima: int, keep: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, least, total = [], [], []
            for _, part in Texts.of(batch.column("_text")).chunks(1 << 20):
                h, count = _shingle_hashes(part, shingle)
                found.append(majority(h, count))
                total.append(count)
                rows = np.zeros((len(count), minima), np.uint64)
                some = np.flatnonzero(count)
                for k in range(minima if len(some) else 0):
                    rows[some, k] = np.minimum.reduceat(mix(h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & int(ALL))), np.cumsum(count)[some] - count[some])
                least.append(rows)
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            least = np.concatenate(least).ravel() if least else np.zeros(0, np.uint64)
            n = np.concatenate(total) if total else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(least) + 1, minima) if minima else np.zeros(len(fp) + 1, np.int64), pa.int32()), pa.array(least.view(np.int64)))
            yield pa.RecordBatch.from_arrays([id_array(ids(batch.column("_id"))), pa.array(fp.view(np.int64)), pa.array(n, pa.int64()), lists, *(batch.column(c) for c in keep)], ["_id", "fp", "n_shingles", "minima", *keep])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, minima: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, fp, n_shingles, minima) per row. Texts shorter than a shingle are one; texts without words have fingerprint 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(_fingerprint(shingle, minima), "_id bigint, fp bigint, n_shingles bigint, minima array<bigint>")


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """One key for each choice of ``blocks - radius`` blocks of the fingerprint."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return F.array(*(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)))


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit b of fingerprint i is bit i % 64 of ``planes[b, i // 64]``."""
    width = -(-len(fp) // 64) * 64
    bits = np.zeros((64, width), np.uint8)
    bits[:, : len(fp)] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def close_pairs(fp: np.ndarray, key: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j with equal key and at most ``radius`` differing bits; ``key`` is sorted."""
    n = len(fp)
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(cuts, n))
    top = np.repeat(cuts + size, size)  # end of the bucket of each
    lane = np.flatnonzero(top - np.arange(n) > 1)
    if not len(lane):
        return
    vertical = planes(fp)
    low, high = (lane + 1) // 64, (top[lane] - 1) // 64
    words = high - low + 1
    stop = np.cumsum(words)
    k = max(1, radius.bit_length())
    preset = (1 << k) - 1 - radius
    for begin in range(0, int(stop[-1]), ITEMS):
        item = np.arange(begin, min(begin + ITEMS, int(stop[-1])))
        at = np.searchsorted(stop, item, side="right")
        i, w = lane[at], low[at] + item - (stop[at] - words[at])
        over = ~(BELOW[np.clip(top[i] - w * 64, 0, 64)] & ~BELOW[np.clip(i + 1 - w * 64, 0, 64)])
        own = fp[i]
        counter = [np.full(len(i), ALL if preset >> b & 1 else np.uint64(0)) for b in range(k)]
        for b in range(64):
            carry = vertical[b][w] ^ (np.uint64(0) - (own >> np.uint64(b) & np.uint64(1)))
            for c in counter:
                both = c & carry
                c ^= carry
                carry = both
            over |= carry
            if b % 8 == 7:
                live = np.flatnonzero(over != ALL)
                if not len(live):
                    break
                if len(live) < len(over):
                    i, w, own, over, counter = i[live], w[live], own[live], over[live], [c[live] for c in counter]
        else:
            # nearly all of a dense bucket are hits, 64 for each item
            hits = np.cumsum(np.bitwise_count(~over), dtype=np.int64)
            edge = np.searchsorted(hits, np.arange(HANDED, int(hits[-1]) - 63, HANDED)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(over)]):
                hit, lane_of = np.nonzero(np.unpackbits((~over[lo:hi]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                yield i[lo:hi][hit], w[lo:hi][hit] * 64 + lane_of


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links between the same vertices, with the same components: each vertex and the least it reaches."""
    node, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a):]
    root = np.arange(len(node))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(node)))
    return node[own], node[root[own]]


def _compare(radius: int):
    def links(key: np.ndarray, fp: np.ndarray, vertex: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((vertex, key))
        key, fp, vertex = key[order], fp[order], vertex[order]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in close_pairs(fp, key, radius):
            i, j = forest(vertex[i], vertex[j])
            a.append(i)
            b.append(j)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate((h, batch.column(c).to_numpy(zero_copy_only=False))) for h, c in zip(held, ("key", "fp", "vertex"))]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last bucket may go on
            held = [r[cut:] for r in rows]
            if cut:
                yield links(rows[0][:cut], rows[1][:cut].view(np.uint64), rows[2][:cut])
        if len(held[0]):
            yield links(held[0], held[1].copy().view(np.uint64), held[2])

    return run


def _bucketed(keyed: DataFrame, radius: int) -> DataFrame:
    lanes = keyed.select("key", "fp", "vertex").repartition("key").sortWithinPartitions("key")
    return lanes.mapInArrow(_compare(radius), "a bigint, b bigint")


def simhash_components(docs: DataFrame, radius: int = 2, shingle: int = 3, blocks: int = 8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id, the least id reachable over links of at most ``radius`` bits.

    Exact for any radius below ``blocks``. Null and wordless texts have
    fingerprint zero and link like any other. Rows without id take part; their
    component is null only where it holds no id at all. Ids are below 2^62.
    Repeated rows are kept.
    """
    hashed = stage(fingerprints(docs, shingle, id_col=id_col, text=text).select("_id", "fp"), "fingerprints")
    # a fingerprint without any id stands above all ids, by its own value
    nameless = F.xxhash64("fp").bitwiseAND(NAMELESS - 1).bitwiseOR(NAMELESS)
    vertices = hashed.groupBy("fp").agg(F.min("_id").alias("vertex")).withColumn("vertex", F.coalesce("vertex", nameless))
    keyed = stage(vertices, "vertices")
    links = _bucketed(keyed.withColumn("key", F.explode(block_keys(F.col("fp"), radius, blocks))), radius)
    stars = components(links)
    found = keyed.join(stars, keyed["vertex"] == stars["member"], "left").select("fp", F.coalesce("component", "vertex").alias("component"))
    out = hashed.join(found, "fp")
    return out.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("component") < NAMELESS, F.col("component")).alias("component_id"))
