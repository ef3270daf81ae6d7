"""Best-fit packing of documents into sequences of fixed size.

Documents become pieces of at most ``capacity`` tokens. Pieces and the gaps at
the ends of sequences are kept sorted by size, longest pieces first, and are
matched in supersteps: the pieces of the greatest length still waiting meet the
gaps that succeed them in size; where several want gaps of one size, the rank of
a piece decides which gap it gets; gaps shrink, and the next length follows.

Equal sizes are interchangeable, so both sorted lists are runs: all pieces of
one length, and all gaps of one size, however many. A superstep moves whole
runs, and gives what best fit gives to one piece after the other: a gap takes
pieces of a length until none fits, since it is then the tightest. There are at
most ``capacity`` lengths, and a gap at least halves whenever it is used, so
the sweep and the matches it writes down are bounded by the capacity whatever
the number of documents. Where a vocabulary never looks across white space,
a task encodes a word once. All that is done per piece (encoding, ranks within a
length, the step from rank to gap) is spread over the tasks.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.text import Texts, span_hash
from cellgauge.operators.ranks import hash_rank
from cellgauge.session import stage

RANK_BITS = 43
#: texts gathered before they are encoded together, distinct words a task remembers
TEXT_BYTES, WORDS = 4 << 20, 1 << 20
#: words encoded as one text
JOINED = 4096
#: fixed values: a pre-tokenizer of this pattern, which keeps matches only, and such normalizers never look across ASCII white space
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = {"NFC", "Replace", "Lowercase"}
TAIL, SOLID = np.zeros(256, bool), np.zeros(256, bool)
TAIL[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[]^_`{}~"]] = True  # not the apostrophe, nor what added tokens are made of
SOLID[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def wordwise(path: str) -> bool:
    """Whether the ids of a text are those of its words (at ASCII white space) one after the other."""
    with open(path, "rb") as f:
        model = json.load(f)
    steps = (model.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, norm = steps[0], model.get("normalizer") or {}
    spaces = [n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norm.get("normalizers", []) if n["type"] == "Replace"]
    whole = any(c in t["content"] for t in model.get("added_tokens", []) for c in " \t\n\v\f\r") or any(set(t["content"]) & set("!\"#$%&()*+,-./:;=?@[]^_`{}~") for t in model.get("added_tokens", [])) or any(t[k] for t in model.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    return (
        first.get("pattern") == {"Regex": WORDWISE} and first["behavior"] == "Removed" and first["invert"] and model.get("post_processor") is None
        and [s["type"] for s in steps[1:]] == ["ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        and {n["type"] for n in norm.get("normalizers", [])} <= NORMALIZERS and all(spaces) and not whole
    )


class Encoder:
    """Ids of texts, all in one array. Words that a task has met are not encoded again where that gives the same ids.

    The file must stand at the same path on every executor.
    """

    mark = b"\0"

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model, self.end_id, self.by_word = Tokenizer.from_file(path), end_id, wordwise(path)
        self.model.no_truncation()
        self.model.no_padding()
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.added = np.array([ord(t[0]) for t in added if t and t.isascii()], np.uint8)
        self.lower = self.by_word and all(t.isascii() for t in added) and self.model.normalizer.normalize_str("AZ") == "az"
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.ids = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), np.zeros(0, "<u4")

    def folded(self, part: Texts) -> Texts:
        """A-Z in lower case, as the vocabulary takes them, but for texts with a character that begins an added token."""
        if not self.lower:
            return part
        low = part.folded()
        for t in np.unique(part.owner(np.flatnonzero(np.isin(part.buf, self.added)))):
            low.buf[part.at[t]: part.at[t + 1]] = part.buf[part.at[t]: part.at[t + 1]]
        return low

    @staticmethod
    def cut_tails(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, with punctuation behind a last letter or digit as one of its own: the pattern cuts there anyway."""
        starts, ends, first = part.tokens()
        if not len(starts):
            return starts, ends, first
        last = np.maximum.accumulate(np.where(TAIL[part.buf], -1, np.arange(len(part.buf))))[ends - 1]
        cut = (last >= starts) & (last < ends - 1) & SOLID[part.buf[last]]
        tops = np.sort(np.concatenate((starts, last[cut] + 1)))
        return tops, np.sort(np.concatenate((ends, last[cut] + 1))), np.searchsorted(tops, part.at)

    def flat_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``flat``, for words: many in one text, told apart by a word whose only id no other of them has."""
        plain = [i for i, w in enumerate(words) if self.mark not in w]
        others = sorted(set(range(len(words))) - set(plain))
        mark = self.model.encode(self.mark.decode(), add_special_tokens=False).ids
        runs = [plain[i: i + JOINED] for i in range(0, len(plain), JOINED)]
        between = b" " + self.mark + b" "
        texts = [(between.join(words[i] for i in run)).decode() for run in runs] + [words[i].decode() for i in others]
        found = [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        pieces, sizes = [], np.zeros(len(words), np.int64)
        for run, ids in zip(runs, found):
            own = ids != mark[0]
            ends = np.append(np.flatnonzero(~own), len(ids))
            if len(mark) != 1 or len(ends) != len(run):
                return self.flat([w.decode() for w in words])
            sizes[run] = np.diff(ends, prepend=-1) - 1
            pieces.append(ids[own])
        sizes[others] = [len(ids) for ids in found[len(runs):]]
        ids = np.concatenate([*pieces, *found[len(runs):]]) if len(words) else np.zeros(0, "<u4")
        at = np.zeros(len(words), np.int64)
        order = np.array(plain + others, np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return ids, np.stack((at, sizes), axis=1)

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each start and how many they are."""
        found = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.array([len(ids) for ids in found], np.int64)
        return np.array([i for ids in found for i in ids], "<u4"), np.stack((np.cumsum(size) - size, size), axis=1)

    def __call__(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text, and where each text starts."""
        if self.by_word:
            part = self.folded(part)
            starts, ends, first = self.cut_tails(part)
            words, one, which = np.unique(span_hash(part.prefix(), starts, ends), return_index=True, return_inverse=True)
            new = np.flatnonzero(~np.isin(words, self.known))
            if len(new):
                ids, spans = self.flat_words([part.buf[a:b].tobytes() for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist())])
                known = np.concatenate((self.known, words[new]))
                order = np.argsort(known)
                self.known, self.at = known[order], np.concatenate((self.at, spans + [len(self.ids), 0]))[order]
                self.ids = np.concatenate((self.ids, ids))
            at, size = self.at[np.searchsorted(self.known, words)][which].T if len(which) else np.zeros((2, 0), np.int64)
            total = np.concatenate(([0], np.cumsum(size)))
            ids = self.ids[np.arange(total[-1]) + np.repeat(at - total[:-1], size)]
            ends = total[first[1:]]
            if len(self.known) > WORDS:
                self.forget()
        else:
            ids, spans = self.flat([part.slice(i).decode() for i in range(len(part))])
            ends = spans.sum(axis=1)
        return np.insert(ids, ends, self.end_id), np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, end_id)
        for batch in batches:
            for at, part in Texts.of(batch.column("_text")).chunks(TEXT_BYTES):
                ids, edges = encode(part)
                count = -(-np.diff(edges) // capacity)
                doc = np.repeat(np.arange(len(part)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(edges)[doc] - start)
                raw, low = memoryview(ids.astype("<u4").tobytes()), 4 * (edges[doc] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(low.tolist(), (low + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(pa.array(at + doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(counts: Mapping[int, int], capacity: int) -> np.ndarray:
    """Matches of runs: rows (length, first rank, pieces, pieces per gap, first sequence, offset), by length and rank.

    The result is that of best fit over all pieces, longest first.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # free size: runs of (first sequence, sequences)
    sizes: list[int] = []
    opened, matches = 0, []

    def give_back(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)  # the successor: the least gap that holds the length
            if at < len(sizes):
                size = sizes[at]
                first, n = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[at]
            else:
                size, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            per_gap = size // length
            full, rest = min(n, left // per_gap), 0
            if full < n:
                rest = left - full * per_gap  # fewer than a gap takes
            used = full + (rest > 0)
            matches.append((length, rank, full * per_gap + rest, per_gap, first, capacity - size))
            give_back(size - per_gap * length, first, full)
            give_back(size - rest * length, first + full, used - full)
            give_back(size, first + used, n - used)
            rank += full * per_gap + rest
            left -= full * per_gap + rest
    return np.array(matches, np.int64).reshape(-1, 6)


def _place(matches: np.ndarray):
    order = np.lexsort((matches[:, 1], matches[:, 0]))
    length, first, _, per_gap, sequence, offset = matches[order].T
    keys = length << RANK_BITS | first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(keys, size << RANK_BITS | (rank - 1), side="right") - 1
            nth = rank - 1 - first[at]
            found = pa.array(sequence[at] + nth // per_gap[at]), pa.array(offset[at] + nth % per_gap[at] * size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text", seed: int = 42
) -> DataFrame:
    """Per piece: id, piece (from 0), start, length, ids_crc32, sequence_id and offset.

    A document is its ids without added special tokens, then ``end_id``. Null
    texts count as empty, so every row has a piece. Only documents of more than
    ``capacity`` tokens are cut. ``ids_crc32`` is that of the piece's ids as
    little-endian unsigned 32-bit numbers. Every row is a document of its own,
    repeated rows and rows without id too; no rows give no pieces. Sequences
    are numbered from 0 and filled from offset 0 without gaps between pieces.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    cut = rows.mapInArrow(_cut(tokenizer, capacity, end_id), "_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    pieces = stage(cut.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    # at most one row per length, that is ``capacity``
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    ranked = hash_rank(pieces, ["length"], seed, ["_n"], rank="_rank").select("_id", "piece", "start", "length", "ids_crc32", "_rank")
    placed = ranked.mapInArrow(_place(best_fit(counts, capacity)), "_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return placed.withColumnRenamed("_id", id_col)
