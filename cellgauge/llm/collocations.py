"""Collocations by dynamic itemset counting.

The corpus is cut into shards that are scanned in a cycle. Counting starts with
single words; as soon as both shorter parts of a phrase (all but its last and
all but its first word) have reached the threshold, the phrase is activated and
counted from the next shard on, while its parts are still being counted. Each
phrase is counted for one full cycle, so its count is exact, and the scans of
different lengths share their passes.

When a phrase starts follows from the steps in which its parts reached the
threshold, so no list of candidates has to be made or carried: a task looks the
two steps up and knows whether the phrase counts now. The steps stand in a
table of fixed size, one entry for each slot of a hash. Parts that share a slot
share the earlier step; that can only activate more phrases and earlier, which
costs work but changes no count, as every phrase keeps the start that the table
gives it from the first time both parts are in.

Counts travel packed: a task sends the sorted keys of a batch and their counts
to hash buckets, where they are added to the counts of the steps before.
Phrases leave a bucket when their cycle is complete. The words of the frequent
phrases are read last, shard by shard and each time only those not yet found,
of which there are few after a small part; tables of them give the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgauge.llm.text import Texts, gram_hash, mix, span_hash
from cellgauge.session import discard, scratch_path, stage

LONGEST = 4
SHARDS = 3
#: slots of the table of steps, for each length
SLOT_BITS = 22
NEVER = 255
#: bits of the filter of phrases whose words are still to be read
MASK_BITS = 26
#: share of the first shard that is read for words before the rest of it
FIRST_READ = 16
#: keys a task gathers before it counts them
HELD = 1 << 21
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
GAP = BREAK.copy()
GAP[[9, 32]] = True

STATE, REACHED, COUNTED = 0, 1, 2
PACKED = "bucket int, keys binary, counts binary, starts binary, lengths binary"
_TYPES = (("keys", np.uint64), ("counts", np.int64), ("starts", np.uint8), ("lengths", np.uint8))


class Words:
    """The words of lower-cased texts: spans, hashes that tell languages apart, and the number of the piece.

    ``langs`` holds the hash of the language of each text, which is also the
    key (of length 0) under which its words are counted together.
    """

    def __init__(self, part: Texts, langs: np.ndarray):
        self.langs = langs
        self.low = part.folded()
        self.starts, self.ends, first = self.low.tokens(GAP)
        self.text = np.repeat(np.arange(len(part)), np.diff(first))
        self.own = mix(span_hash(self.low.prefix(), self.starts, self.ends) ^ langs[self.text])
        breaks = np.cumsum(BREAK[self.low.buf])
        self.piece = (breaks[self.starts] if len(self.starts) else np.zeros(0, np.int64)) + self.text

    def keys(self, n: int) -> np.ndarray:
        """The key of the ``n`` words from each word on; runs across pieces are in it too."""
        return self.own if n == 1 else gram_hash(self.own, n) ^ np.uint64(n)

    def whole(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each word on stand in one piece."""
        return self.piece[n - 1:] == self.piece[: len(self.piece) - n + 1]

    def phrase(self, i: int, n: int) -> str:
        return b" ".join(self.low.buf[a:b].tobytes() for a, b in zip(self.starts[i: i + n].tolist(), self.ends[i: i + n].tolist())).decode()


def _lang_hashes(column: pa.Array) -> np.ndarray:
    import xxhash

    coded = column.dictionary_encode()
    return np.array([xxhash.xxh64_intdigest(v.as_py(), 7) for v in coded.dictionary] or [0], np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, Words]]:
    langs = _lang_hashes(batch.column("_lang"))
    for at, part in Texts.of(batch.column("_text")).chunks():
        yield at, Words(part, langs[at: at + len(part)])


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _merged(columns: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Each key once with the sum of its counts, by key; a key has one start and one length."""
    keys, counts, starts, lengths = (np.concatenate(c) for c in zip(*columns))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    return [keys[head], np.add.reduceat(counts[order], head) if len(head) else counts, starts[order[head]], lengths[order[head]]]


def _packed(columns: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([c.astype(t).tobytes()], pa.binary()) for c, (_, t) in zip(columns, _TYPES)]


def _unpacked(table: pa.Table) -> list[tuple[np.ndarray, ...]]:
    rows = [tuple(np.frombuffer(r[name], t) for name, t in _TYPES) for r in table.select([n for n, _ in _TYPES]).to_pylist()]
    return rows or [tuple(np.zeros(0, t) for _, t in _TYPES)]


def _count(step: int, shards: int, longest: int, bits: int, buckets: int, known):
    """Counts of the phrases that are active in this step, by bucket."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        merged = _merged(held)
        bucket = (merged[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # rises with the key
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            part = [c[cuts[b]: cuts[b + 1]] for c in merged]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *_packed(part)], PACKED.replace(" int", "").replace(" binary", "").split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, held, total = known.value, [], 0
        for batch in batches:
            for _, words in _parts(batch):
                some = []
                if step < shards:
                    some.append((words.own, 0, 1))
                    size = np.bincount(words.text, minlength=len(words.langs))
                    held.append((words.langs, size, np.zeros(len(size), np.uint8), np.zeros(len(size), np.uint8)))
                shorter = words.own
                for n in range(2, longest + 1):
                    if len(words.own) < n:
                        break
                    at = reached[n - 2][_slots(shorter, bits)]
                    start = np.maximum(at[:-1], at[1:]).astype(np.int64) + 1
                    live = np.flatnonzero((start <= step) & (step < start + shards) & words.whole(n))
                    shorter = words.keys(n)
                    some.append((shorter[live], start[live], n))
                for keys, start, n in some:
                    held.append((keys, np.ones(len(keys), np.int64), np.broadcast_to(np.uint8(start) if np.isscalar(start) else start.astype(np.uint8), keys.shape), np.full(len(keys), n, np.uint8)))
                    total += len(keys)
                if total > HELD:
                    yield from flush(held)
                    held, total = [], 0
        if total:
            yield from flush(held)

    return run


def _add(step: int, shards: int, longest: int, bits: int, threshold: int, known):
    """New counts of a bucket, what has reached the threshold, and what has completed its cycle."""

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        keys, counts, starts, lengths = _merged(_unpacked(new) + _unpacked(old))
        bucket = (new if new.num_rows else old).column("bucket")[0].as_py()
        enough = counts >= threshold
        fresh = []
        for n in range(1, longest):
            slot = _slots(keys[enough & (lengths == n)], bits)
            fresh.append(np.unique(slot[known.value[n - 1][slot] == NEVER]) + (n - 1 << bits))
        over = starts.astype(np.int64) + shards - 1 <= step
        out = []
        for kind, columns in (
            (STATE, [c[~over] for c in (keys, counts, starts, lengths)]), (COUNTED, [c[over & enough] for c in (keys, counts, starts, lengths)]),
            (REACHED, [np.concatenate(fresh).astype(np.uint64), *[np.zeros(0)] * 3]),
        ):
            if len(columns[0]):
                out.append(pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), *_packed(columns)], ["kind", "bucket", *(n for n, _ in _TYPES)]))
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((n, pa.binary()) for n, _ in _TYPES)])
        return pa.Table.from_batches(out, schema)

    return run


def _flat(*names: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[n], np.int64)) for n in names], list(names))

    return run


def _read(longest: int, wanted):
    """The words of phrases whose keys pass the filter, each once a batch; for length 0 the language alone."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())

    def named(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["lang", "length", "phrase", "key"])

    def passes(keys: np.ndarray) -> np.ndarray:
        slot = _slots(keys, MASK_BITS)
        return wanted.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, seen = batch.column("_lang").to_pylist(), [np.zeros(0, np.uint64)] * (longest + 1)
            for at, words in _parts(batch):
                rows = []
                for n in range(min(longest, len(words.own)) + 1):
                    keys = words.keys(n) if n else words.langs
                    some = np.flatnonzero(words.whole(n) & passes(keys) if n else passes(keys))
                    new, first = np.unique(keys[some], return_index=True)
                    fresh = ~np.isin(new, seen[n])
                    seen[n] = np.concatenate((seen[n], new[fresh]))
                    found = zip(new[fresh].view(np.int64).tolist(), some[first[fresh]].tolist())
                    rows += [(langs[at + words.text[i]], n, words.phrase(i, n), k) if n else (langs[at + i], 0, "", k) for k, i in found]
                yield named(rows)

    return run


def frequent_phrases(docs: DataFrame, threshold: int = 30, longest: int = LONGEST, shards: int = SHARDS, bits: int = SLOT_BITS, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, length, phrase, f) of all phrases of up to ``longest`` words with f >= ``threshold``, and one row of length 0 for each language with so many words, whose f counts them all."""
    spark = docs.sparkSession
    rows = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(lang), F.lit("und")).alias("_lang"), F.col(text).alias("_text"))
    # a scan reads one shard only
    path = scratch_path(spark, "shards")
    rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(path)
    sharded = spark.read.schema("_lang string, _text string, shard int").parquet(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reached = [np.full(1 << bits, NEVER, np.uint8) for _ in range(longest - 1)]
    state, step, last = spark.createDataFrame([], PACKED), 0, 0
    schema, folder = f"kind int, {PACKED}", scratch_path(spark, "counts")
    while step <= last + shards:
        known = spark.sparkContext.broadcast(reached)
        new = sharded.filter(F.col("shard") == step % shards).select("_lang", "_text").mapInArrow(_count(step, shards, longest, bits, buckets, known), PACKED)
        added = new.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(_add(step, shards, longest, bits, threshold, known), schema)
        added.write.partitionBy("kind").parquet(f"{folder}/step={step}")
        found = spark.read.schema(schema).parquet(f"{folder}/step={step}")
        state = found.filter(F.col("kind") == STATE).drop("kind")
        # slots that are set for the first time: never more than the table has
        fresh = found.filter(F.col("kind") == REACHED).select("keys").mapInArrow(_flat("keys"), "keys bigint").distinct().toArrow().column("keys").to_numpy()
        known.unpersist()
        if step:
            discard(spark, f"{folder}/step={step - 1}/kind={STATE}")
        for n in range(longest - 1):
            reached[n][fresh[fresh >> bits == n] & (1 << bits) - 1] = step
        last = step if len(fresh) else last
        step += 1
    counted = spark.read.schema(f"{schema}, step int").parquet(folder).filter(F.col("kind") == COUNTED).select("keys", "counts")
    counts = stage(counted.mapInArrow(_flat("keys", "counts"), "keys bigint, counts bigint"), "frequent")
    return _with_words(sharded, counts, longest, shards)


def _mask(keys: DataFrame) -> np.ndarray:
    """The filter that all keys pass, as a bitmap put together by aggregates: 2^MASK_BITS bits reach the driver."""
    slot = F.shiftrightunsigned("keys", 64 - MASK_BITS) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(1 << MASK_BITS - 3, np.uint8)
    for row in parts.collect():
        bits = np.frombuffer(row["bits"], np.uint8)
        out[(row["at"] - 1) * 4096: (row["at"] - 1) * 4096 + len(bits)] = bits
    return out


def _with_words(sharded: DataFrame, counts: DataFrame, longest: int, shards: int) -> DataFrame:
    spark, left, out = sharded.sparkSession, counts, None
    turn = F.pmod(F.xxhash64("_text"), F.lit(FIRST_READ))
    first = F.col("shard") == 0
    for part in (first & (turn == 0), first & (turn != 0), *(F.col("shard") == i for i in range(1, shards))):
        wanted = spark.sparkContext.broadcast(_mask(left))
        seen = sharded.filter(part).select("_lang", "_text").mapInArrow(_read(longest, wanted), "lang string, length int, phrase string, key bigint")
        found = stage(seen.join(left, F.col("key") == F.col("keys")).groupBy("lang", "length", "phrase", "keys").agg(F.max("counts").alias("f")), "phrases")
        wanted.unpersist()
        out = found if out is None else out.unionByName(found)
        left = stage(left.join(found.select("keys"), "keys", "left_anti"), "unread")
        if left.isEmpty():
            break
    return out.drop("keys")


def _between(words: Column, k: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, k, n), " ")


def collocations(
    docs: DataFrame, threshold: int = 30, limit: int = 2000, share: int = 80, longest: int = LONGEST, shards: int = SHARDS, bits: int = SLOT_BITS,
    lang: str = "lang", text: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language the ``limit`` best phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends,
    and pieces into words at spaces and tabs. ``a`` counts the places of a
    phrase, ``n`` all words of the language. A phrase with ``a >= threshold``
    is cut after its first words so that floor(2000000 a / (l + r)) is least,
    ``l`` and ``r`` being the counts of both parts; ties go to the earliest
    cut. Phrases inside a longer one that has at least ``share`` percent of
    their count go. The order is by score and count, both falling, then phrase.

    Null texts have no words; a null language is ``und``. Every row counts,
    repeated ones too. No rows, or no frequent phrase, give no rows.
    """
    found = frequent_phrases(docs, threshold, longest, shards, bits, lang, text)
    counts = found.filter("length > 0").select("lang", "phrase", "f")
    words = found.filter("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    cut = words.select("lang", "phrase", "length", "a", "_w", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("_k"))
    cut = cut.select("lang", "phrase", "a", "_k", _between(F.col("_w"), F.lit(1), F.col("_k")).alias("_first"), _between(F.col("_w"), F.col("_k") + 1, F.col("length") - F.col("_k")).alias("_rest"))
    left = counts.select(F.col("lang").alias("_l1"), F.col("phrase").alias("_first"), F.col("f").alias("l"))
    right = counts.select(F.col("lang").alias("_l2"), F.col("phrase").alias("_rest"), F.col("f").alias("r"))
    cut = cut.join(left, (cut["lang"] == F.col("_l1")) & (cut["_first"] == left["_first"])).join(right, (F.col("lang") == F.col("_l2")) & (cut["_rest"] == right["_rest"]))
    score = F.expr("cast(a as decimal(38, 0)) * 2000000 div (cast(l as decimal(38, 0)) + r)")
    best = cut.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_b"))

    size = lambda n: F.sequence(F.lit(1), F.col("length") - n + 1)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda n: F.transform(size(n), lambda k: _between(F.col("_w"), k, n))))
    cover = words.filter("length > 2").select(F.col("lang").alias("_lang"), F.explode(inner).alias("_inner"), "a").groupBy("_lang", "_inner").agg(F.max("a").alias("_longer"))
    covered = (best["lang"] == cover["_lang"]) & (best["phrase"] == cover["_inner"]) & (F.lit(100).cast("decimal(38,0)") * cover["_longer"] >= F.lit(share) * best["a"])
    rest = best.join(cover, covered, "left_anti")
    order = W.partitionBy("lang").orderBy(F.desc("_b.score"), F.desc("a"), "phrase")
    top = rest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    totals = found.filter("length = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    return top.join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", F.col("_b.l").alias("l"), F.col("_b.r").alias("r"), "n", F.col("_b.score").alias("score"))
