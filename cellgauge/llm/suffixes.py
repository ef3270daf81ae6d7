"""Exact substring dedup by suffix arrays.

Which bytes go: those covered by a string of ``length`` bytes that also starts
in a document of smaller id. Three steps find them without comparing documents
in pairs.

1. Every string of ``length`` bytes holds an anchor: its short substring of
   least hash. Packs of documents learn which anchors stand in several
   documents (``packs``); all others are out.
2. The bytes around a shared anchor go to the task of the anchor's label, the
   least id that has it. Neighbouring anchors mostly have the same label, so
   what travels are passages. All documents that share a string send it to the
   same label, since the label follows from the anchor alone.
3. There the passages are sorted by a two-stage suffix sort: suffixes smaller
   than their successors are sorted directly, all others follow from scans
   over the buckets of first bytes. Common prefixes of neighbours in that
   order give the classes of equal strings, and each class its least id.

Copies of whole texts are told by their digests and send nothing. Anchors in
more than ``hot`` documents would gather too much at one label: their strings
are classed by hash instead, each once per pack, over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.packs import Pack, Rows, answer_whole, by_pack, columns, dump, pack_count, packed, split
from cellgauge.llm.text import Texts, id_array, inside, mix, span_hash, window_min

ANCHOR = 24
HOT = 1024
SORT_BYTES = 2 << 20
HOT_LABEL = np.iinfo(np.int64).min


def _words_at(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each position on, as numbers that sort like the bytes."""
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    return np.ndarray((len(text) + depth + 8,), ">u8", padded, strides=(1,))


def _sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions by the ``depth`` bytes from each on; only ties look further than eight bytes at a time."""
    key = words[at].astype(np.uint64)
    order = np.argsort(key)
    at, key = at[order], key[order]
    place = np.arange(len(at))
    same = key[1:] == key[:-1]
    for offset in range(8, depth, 8):
        tied = np.zeros(len(place), bool)
        tied[1:] |= same
        tied[:-1] |= same
        group = np.cumsum(np.concatenate(([0], ~same)))[tied] if len(place) else place
        place = place[tied]
        if not len(place):
            break
        key = words[at[place] + offset].astype(np.uint64)
        order = np.lexsort((key, group))
        at[place] = at[place][order]
        key, group = key[order], group[order]
        same = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
    return at


def two_stage_order(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``text`` in the order of their first ``depth`` bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = _words_at(text, depth)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # of runs of one byte
    rises = np.append(text[ends[:-1] + 1] > text[ends[:-1]], False)
    smaller = np.repeat(rises, np.diff(np.concatenate(([-1], ends))))
    direct = _sort_directly(np.flatnonzero(smaller), words, depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # before the empty suffix
    out = []
    for byte in range(256):
        parts, level = [], np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(level):  # runs of this byte, shortest first
            parts.append(level)
            level = level[level > 0] - 1
            level = level[text[level] == byte]
        bucket = np.concatenate((*parts, direct[bounds[byte]: bounds[byte + 1]]))
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        value = text[before]
        before, value = before[value > byte], value[value > byte]
        for other, part in split(value):
            waiting[other].append(before[part])
    return np.concatenate(out)


def neighbour_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes each suffix has in common with the next in order, up to ``depth`` (rounded up to eights)."""
    words = _words_at(text, depth)
    common = np.zeros(max(0, len(order) - 1), np.int64)
    live = np.arange(len(common))
    for offset in range(0, depth, 8):
        differ = words[order[live] + offset].astype(np.uint64) ^ words[order[live + 1] + offset].astype(np.uint64)
        for lead in range(1, 9):
            common[live] += differ < np.uint64(1 << 64 - 8 * lead) if lead < 8 else differ == 0
        live = live[differ == 0]
    return common


def repeated_starts(text: np.ndarray, remaining: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Positions whose next ``length`` bytes also stand at a position of smaller owner. ``remaining``: bytes up to the end of the passage."""
    order = two_stage_order(text, length)
    order = order[remaining[order] >= length]
    if len(order) < 2:
        return order[:0]
    equal = neighbour_prefixes(text, order, length) >= length
    top = np.flatnonzero(np.concatenate(([True], ~equal)))
    least = np.repeat(np.minimum.reduceat(owner[order], top), np.diff(np.append(top, len(order))))
    return order[owner[order] > least]


def anchors(part: Texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of every ``length`` bytes inside one text."""
    k = min(ANCHOR, length)
    n = len(part.buf)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix, at = part.prefix(), np.arange(n - k + 1)
    h = span_hash(prefix, at, at + k)
    # the upper half decides, then the leftmost
    least = window_min(h >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64), length - k + 1)
    chosen = (least[inside(part.at, length, n)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))[: len(chosen)]]
    return chosen, h[chosen]


def _windows(prefix: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the ``length`` bytes at each position."""
    half = at + length // 2
    return span_hash(prefix, at, at + length), mix(span_hash(prefix, at, half) * np.uint64(0xD6E8FEB86659FD93) + span_hash(prefix, half, at + length))


def _tell_anchors(n: int, length: int):
    def run(table: pa.Table) -> pa.Table:
        pack, rows = Pack(table), Rows("abc")
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, part in pack.texts.chunks():
            at, h = anchors(part, length)
            doc = k + part.owner(at)
            told = pack.first[doc]
            hashes.append(h[told])
            owners.append(pack.id[doc[told]])
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        if len(h):
            top = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            low, high = np.minimum.reduceat(owner, top), np.maximum.reduceat(owner, top)
            count = np.where(low < high, np.diff(np.append(top, len(h))), 1)
            h = h[top]
            for dest, part in split((h % np.uint64(n)).astype(np.int64)):
                rows.add(dest, pack.number, 0, dump(h[part]), dump(low[part]), dump(count[part]))
        pack.whole(rows, n, 1)
        return rows.table()

    return run


def _answer_anchors(hot: int):
    def run(table: pa.Table) -> pa.Table:
        rows = Rows("abc", None)
        h, least, count, pack = columns(table, 0, "abc")
        if len(h):
            order = np.argsort(h, kind="stable")
            h, least, count, pack = h[order], least[order].view(np.int64), count[order].view(np.int64), pack[order]
            top = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            size, total = np.diff(np.append(top, len(h))), np.add.reduceat(count, top)
            label = np.where(total > hot, HOT_LABEL, np.minimum.reduceat(least, top))
            told = np.repeat(total > 1, size)
            h, label, pack = h[told], np.repeat(label, size)[told], pack[told]
            for number, part in split(pack):
                rows.add(number, 0, dump(h[part]), dump(label[part]))
        answer_whole(table, rows, 1)
        return rows.table()

    return run


def _send_passages(n: int, length: int):
    k = min(ANCHOR, length)

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        rows = Rows("abcdef")
        if not len(table):
            return rows.table()
        pack = Pack(table)
        shared, label_of, _ = columns(told, 0, "ab")
        order = np.argsort(shared)
        shared, label_of = shared[order], label_of[order].view(np.int64)
        origin = pack.origin(columns(told, 1, "abc"))
        copy = origin < pack.id
        again = ~pack.first & ~copy  # the same row once more
        at = np.flatnonzero(copy)
        if len(at):
            rows.add(pack.number % n, pack.number, 1, dump(pack.id[at]), dump(pack.digest[at, 0]))
        strings: list[list[np.ndarray]] = []
        passages: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for first, part in pack.texts.chunks() if len(shared) else ():
            at, h = anchors(part, length)
            doc = first + part.owner(at)
            slot = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
            keep = (shared[slot] == h) & ~copy[doc] & ~again[doc]
            at, doc, label = at[keep], doc[keep], label_of[slot[keep]]
            low = np.maximum(at + k - length, part.at[doc - first])
            high = np.minimum(at + length, part.at[doc - first + 1])
            warm = label != HOT_LABEL
            if not warm.all():
                span = np.minimum(high[~warm] - length, at[~warm]) - low[~warm] + 1
                starts = np.repeat(low[~warm] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
                starts = np.unique(starts)
                strings.append([*_windows(part.prefix(), starts, length), pack.id[first + part.owner(starts)]])
            low, high, doc, label = low[warm], high[warm], doc[warm], label[warm]
            order = np.lexsort((low, doc, label))
            low, high, doc, label = low[order], high[order], doc[order], label[order]
            new = np.concatenate(([True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1]) | (low[1:] > high[:-1])))[: len(low)]
            top = np.flatnonzero(new)
            if not len(top):
                continue
            high = high[np.append(top[1:], len(low)) - 1]
            low, doc, label = low[top], doc[top], label[top]
            for dest, p in split((mix(label.view(np.uint64)) % np.uint64(n)).astype(np.int64)):
                size = high[p] - low[p]
                take = np.repeat(low[p] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                passages.setdefault(dest, []).append((label[p], pack.id[doc[p]], pack.digest[doc[p], 0], low[p] - part.at[doc[p] - first], size, part.buf[take]))
        for dest, found in passages.items():
            parts = [np.concatenate(p) for p in zip(*found)]
            rows.add(dest, pack.number, 0, *(dump(p) for p in parts[:5]), parts[5].tobytes())
        if strings:
            a, b, owner = (np.concatenate(s) for s in zip(*strings))
            order = np.lexsort((owner, b, a))
            a, b, owner = a[order], b[order], owner[order]
            top = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            low, several = np.minimum.reduceat(owner, top), (np.minimum.reduceat(owner, top) < np.maximum.reduceat(owner, top)).astype(np.int64)
            a, b = a[top], b[top]
            for dest, p in split((a % np.uint64(n)).astype(np.int64)):
                rows.add(dest, pack.number, 2, dump(a[p]), dump(b[p]), dump(low[p]), dump(several[p]))
        return rows.table()

    return run


def _sort_passages(length: int):
    def run(table: pa.Table) -> pa.Table:
        rows = Rows("abcd", None)
        for kind, pack, a, b in zip(*(table.column(c).to_pylist() for c in ("kind", "pack", "a", "b"))):
            if kind == 1:  # copies of whole texts pass through
                rows.add(pack, 1, a, b)
        label, owner, tag, begin, size, pack = columns(table, 0, "abcde")
        text = np.concatenate([np.frombuffer(f.as_buffer(), np.uint8) for k, f in zip(table.column("kind").to_pylist(), table.column("f")) if k == 0] or [np.zeros(0, np.uint8)])
        owner, begin, size = owner.view(np.int64), begin.view(np.int64), size.view(np.int64)
        place = np.cumsum(size) - size
        order = np.argsort(label, kind="stable")
        found: list[tuple[np.ndarray, ...]] = []
        for some in _batches(label[order], size[order]):
            p = order[some]
            stop = np.cumsum(size[p])
            of = np.repeat(np.arange(len(p)), size[p])
            inner = np.arange(int(stop[-1])) - (stop - size[p])[of]
            start = repeated_starts(text[place[p][of] + inner], size[p][of] - inner, owner[p][of], length)
            if len(start):
                found.append((pack[p[of[start]]], owner[p[of[start]]], tag[p[of[start]]], begin[p[of[start]]] + inner[start]))
        if found:
            pack, owner, tag, start = (np.concatenate(f) for f in zip(*found))
            order = np.lexsort((start, tag, owner, pack))
            pack, owner, tag, start = pack[order], owner[order], tag[order], start[order]
            new = np.concatenate(([True], (pack[1:] != pack[:-1]) | (owner[1:] != owner[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + length)))
            top = np.flatnonzero(new)
            end = start[np.append(top[1:], len(start)) - 1] + length
            for number, part in split(pack[top]):
                rows.add(number, 0, dump(owner[top][part]), dump(tag[top][part]), dump(start[top][part]), dump(end[part]))
        a, b, least, several, pack = columns(table, 2, "abcd")
        if len(a):
            order = np.lexsort((b, a))
            a, b, least, several, pack = a[order], b[order], least[order].view(np.int64), several[order] > 0, pack[order]
            top = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            count = np.diff(np.append(top, len(a)))
            told = np.repeat((count > 1) | np.logical_or.reduceat(several, top), count)
            low = np.repeat(np.minimum.reduceat(least, top), count)
            a, b, low, pack = a[told], b[told], low[told], pack[told]
            for number, part in split(pack):
                rows.add(number, 2, dump(a[part]), dump(b[part]), dump(low[part]))
        return rows.table()

    return run


def _batches(label: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Places of whole labels, of about SORT_BYTES together."""
    if not len(label):
        return
    top = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    total = np.concatenate(([0], np.cumsum(size)))
    edge = np.append(top, len(label))
    i = 0
    while i < len(top):
        j = max(i + 1, int(np.searchsorted(total[edge], total[edge[i]] + SORT_BYTES, side="right")) - 1)
        yield np.arange(edge[i], edge[j])
        i = j


def _cut(length: int, with_text: bool):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        pack = Pack(table)
        row_of: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(zip(pack.id.tolist(), pack.digest[:, 0].tolist())):
            row_of.setdefault(key, []).append(i)
        edge = np.zeros(len(pack.texts.buf) + 1, np.int32)
        at = pack.texts.at
        owner, tag, _ = columns(told, 1, "ab")
        for key in zip(owner.view(np.int64).tolist(), tag.tolist()):
            for i in row_of.get(key, ()):
                if at[i + 1] - at[i] >= length:
                    edge[at[i]] += 1
                    edge[at[i + 1]] -= 1
        owner, tag, start, end, _ = columns(told, 0, "abcd")
        for key, a, b in zip(zip(owner.view(np.int64).tolist(), tag.tolist()), start.tolist(), end.tolist()):
            for i in row_of[key]:
                edge[at[i] + a] += 1
                edge[at[i] + b] -= 1
        a, b, least, _ = columns(told, 2, "abc")
        if len(a):
            order = np.argsort(a, kind="stable")
            a, b, least = a[order], b[order], least[order].view(np.int64)
            probe = np.zeros(1 << 16, bool)  # most strings are none of these
            probe[(a & np.uint64(0xFFFF)).astype(np.int64)] = True
            for first, part in pack.texts.chunks():
                starts = np.flatnonzero(inside(part.at, length, len(part.buf)))
                prefix = part.prefix()
                h = span_hash(prefix, starts, starts + length)
                starts = starts[probe[(h & np.uint64(0xFFFF)).astype(np.int64)]]
                h, g = _windows(prefix, starts, length)
                slot = np.searchsorted(a, h)
                doc = pack.id[first + part.owner(starts)]
                gone = np.zeros(len(starts), bool)
                live = np.flatnonzero((slot < len(a)) & (a[np.minimum(slot, len(a) - 1)] == h))
                while len(live):  # equal first hashes stand together
                    s = slot[live]
                    gone[live] |= (b[s] == g[live]) & (least[s] < doc[live])
                    slot[live] += 1
                    live = live[slot[live] < len(a)]
                    live = live[a[slot[live]] == h[live]]
                starts = starts[gone] + at[first]
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + length, -1)
        np.cumsum(edge, out=edge)
        covered = edge[:-1] > 0
        del edge
        begins = covered.copy()
        begins[1:] &= ~covered[:-1]
        cut = at[:-1][at[:-1] < at[1:]]
        begins[cut] |= covered[cut]
        ends = covered.copy()
        ends[:-1] &= ~covered[1:]
        ends[cut[1:] - 1] |= covered[cut[1:] - 1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        per = np.searchsorted(begins, at)
        gone, sha, kept = [], [], []
        for a, b in zip(at.tolist(), at[1:].tolist()):
            left = pack.texts.buf[a:b][~covered[a:b]].tobytes()
            gone.append(b - a - len(left))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left if with_text else None)
        doc_of = np.repeat(np.arange(len(pack.id)), np.diff(per))
        lists = [pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array(v - at[doc_of], pa.int64())) for v in (begins, ends)]
        return pa.table([id_array(pack.id), pa.array(np.diff(at)), pa.array(gone, pa.int64()), pa.array(np.diff(per)), pa.array(sha, pa.string()), *lists, pa.array(kept, pa.binary())],
                        names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends", "kept"])

    return run


def substring_dedup(docs: DataFrame, length: int = 50, hot: int = HOT, with_text: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_ends (bytes) and kept (the bytes left, if asked for).

    A byte goes if a string of ``length`` bytes that covers it also starts in
    a document of smaller id; all strings are judged on the input. Rows of the
    same id don't take from each other; null ids count as larger than all.
    Null texts are empty; texts shorter than ``length`` stay whole. ``hot``
    changes only the way, never the result.
    """
    n = pack_count(docs.sparkSession)
    pages = packed(docs, id_col, text)
    seeds = pages.groupBy("pack").applyInArrow(_tell_anchors(n, length), Rows.schema("abc"))
    told = by_pack(seeds.repartitionById(n, F.col("dest")).groupBy("dest").applyInArrow(_answer_anchors(hot), Rows.schema("abc", None)))
    sent = pages.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(_send_passages(n, length), Rows.schema("abcdef"))
    found = by_pack(sent.repartitionById(n, F.col("dest")).groupBy("dest").applyInArrow(_sort_passages(length), Rows.schema("abcd", None)))
    schema = "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, span_starts array<bigint>, span_ends array<bigint>, kept binary"
    return pages.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(_cut(length, with_text), schema).withColumnRenamed("_id", id_col)
