"""Exchange of seed hashes between packs of documents.

A pack is what one task holds: documents are dealt out by a hash of their id,
once, and every later step that needs texts meets them in the same shuffle
files. Packs tell buckets of the hash space which seeds they hold, as arrays,
each seed once per pack; buckets answer which are shared. So a seed that
stands in a third of all documents costs one entry per pack, and neither texts
nor links of all documents ever pass through one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.llm.text import NULL_ID, Texts, ids


def pack_count(spark: SparkSession) -> int:
    """As many packs as shuffle partitions: whoever sizes one sizes the other."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack_of(doc: np.ndarray, n: int) -> np.ndarray:
    """The packs of documents: their ids' XXH64 with seed 42 modulo ``n``, as ``packed`` has it."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: v << np.uint64(r) | v >> np.uint64(64 - r)
    h = np.full(len(doc), (42 + 8 + int(p5)) & 0xFFFFFFFFFFFFFFFF, np.uint64) ^ turn(doc.view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return np.mod((h ^ h >> np.uint64(32)).view(np.int64), n)


def packed(docs: DataFrame, id_col: str, text: str, rest: bool = False) -> DataFrame:
    """(pack, _id, _text), each pack in a partition of its own. Null ids become the largest, null texts empty.

    ``rest`` adds the other columns as a struct, and last in it _told, which is null where the text is.
    """
    n = pack_count(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID)))
    rows = [F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("pack"), key.alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")]
    if rest:
        rows.append(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text), F.when(F.col(text).isNotNull(), True).alias("_told")).alias("rest"))
    return docs.select(*rows).repartitionById(n, F.col("pack"))


def by_pack(rows: DataFrame) -> DataFrame:
    return rows.repartitionById(pack_count(rows.sparkSession), F.col("pack"))


def dump(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, so that compression finds the empty ones."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T).tobytes()


def load(data: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def columns(table: pa.Table, kind: int, names: str) -> list[np.ndarray]:
    """The arrays of all rows of a kind end to end, and the pack each value came from."""
    rows = [(p, *(table.column(n)[i].as_buffer() for n in names)) for i, (k, p) in enumerate(zip(table.column("kind").to_pylist(), table.column("pack").to_pylist())) if k == kind]
    parts = [[load(r[j + 1]) for r in rows] for j in range(len(names))]
    origin = [np.full(len(v), r[0], np.int64) for r, v in zip(rows, parts[0])] if rows else []
    return [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts] + [np.concatenate(origin) if origin else np.zeros(0, np.int64)]


def split(dest: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each destination with the places of its values, in their order."""
    order = np.argsort(dest, kind="stable")
    cuts = np.flatnonzero(np.diff(dest[order])) + 1
    for part in np.split(order, cuts) if len(dest) else []:
        yield int(dest[part[0]]), part


class Rows:
    """Collects rows (dest, pack, kind, a, b, ...) of arrays."""

    def __init__(self, names: str, dest: str | None = "dest"):
        self.names = names
        self.fields = [*([dest] if dest else []), "pack", "kind", *names]
        self.rows: list[tuple] = []

    def add(self, *values) -> None:
        self.rows.append(values + (b"",) * (len(self.fields) - len(values)))

    def table(self) -> pa.Table:
        kinds = [pa.int32()] * (len(self.fields) - len(self.names)) + [pa.binary()] * len(self.names)
        data = list(zip(*self.rows)) if self.rows else [()] * len(self.fields)
        return pa.table([pa.array(d, k) for d, k in zip(data, kinds)], names=self.fields)

    @staticmethod
    def schema(names: str, dest: str | None = "dest") -> str:
        return ", ".join([*([f"{dest} int"] if dest else []), "pack int", "kind int", *(f"{n} binary" for n in names)])


class Pack:
    """The documents of a pack: ids, whole-text digests, and which rows repeat an earlier text of the pack."""

    def __init__(self, table: pa.Table):
        self.number = table.column("pack")[0].as_py() if len(table) else -1
        self.id = ids(table.column("_id")) if len(table) else np.zeros(0, np.int64)
        self.texts = Texts.of(table.column("_text"))
        flat = b"".join(hashlib.blake2b(self.texts.slice(i), digest_size=16).digest() for i in range(len(self.id)))
        self.digest = np.frombuffer(flat, np.uint64).reshape(-1, 2)
        order = np.lexsort((self.id, self.digest[:, 1], self.digest[:, 0]))
        same = np.zeros(len(order), bool)
        same[1:] = (self.digest[order][1:] == self.digest[order][:-1]).all(axis=1)
        self.first = np.empty(len(order), bool)  # the row of least id with its text
        self.first[order] = ~same

    def whole(self, rows: Rows, n: int, kind: int) -> None:
        """Tell the buckets each distinct text."""
        own = np.flatnonzero(self.first)
        for dest, part in split((self.digest[own, 0] % np.uint64(n)).astype(np.int64)):
            at = own[part]
            rows.add(dest, self.number, kind, dump(self.digest[at, 0]), dump(self.digest[at, 1]), dump(self.id[at]))

    def origin(self, told: list[np.ndarray]) -> np.ndarray:
        """For each row the least id of its text, as far as the buckets and the pack know."""
        first, second, least = told[0], told[1], told[2].view(np.int64)
        known = {(a, b): c for a, b, c in zip(first.tolist(), second.tolist(), least.tolist())}
        own: dict[tuple[int, int], int] = {}
        keys = list(map(tuple, self.digest.tolist()))
        for key, i in zip(keys, self.id.tolist()):
            own[key] = min(own.get(key, i), i)
        return np.array([min(known.get(k, own[k]), own[k]) for k in keys], np.int64)


def answer_whole(table: pa.Table, rows: Rows, kind: int) -> None:
    """Answer packs with the least id of each text that several of them hold."""
    a, b, least, pack = columns(table, kind, "abc")
    if not len(a):
        return
    order = np.lexsort((b, a))
    a, b, least, pack = a[order], b[order], least[order].view(np.int64), pack[order]
    top = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    size = np.diff(np.append(top, len(a)))
    low = np.repeat(np.minimum.reduceat(least, top), size)
    told = np.repeat(size > 1, size)
    a, b, low, pack = a[told], b[told], low[told], pack[told]
    for number, part in split(pack):
        rows.add(number, kind, dump(a[part]), dump(b[part]), dump(low[part]))
