"""Hard-negative mining by lists that the anchors of a cluster share.

Anchors are clustered by angle. For a cluster all candidates stand in one list,
sorted by a bound on their score: with an angle of at most ``wide`` between an
anchor and the centre of its cluster, and ``theta`` between a candidate and that
centre, no score exceeds ``|anchor| |candidate| cos(max(0, theta - wide))``.
Every anchor walks the list of its cluster from the top until the bound falls
below what could still change its result; that is the certificate that the
result is exact.

The list is cut into bands of growing length. A histogram of the bounds per
cluster places the cuts, so the list itself is never gathered or sorted whole,
and the part that no anchor reaches is never built. In each round the tasks that
hold the candidates hand out those of the next band, in blocks sorted by bound;
anchors meet the blocks of their cluster in a join, and only entries better than
an anchor's results so far come out. Anchors that are certified take no further
part.

There are two walks: the first finds the positives, the second, with the scores
of the positives known, the negatives just below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgauge.session import stage

SCALE = 256
BINS = 1024
#: anchors that clusters are fitted on, and clusters, at most
FIT_ROWS, CLUSTERS = 4096, 256
#: anchors in one row of a join; length of the first band, and how much longer each further one is
PART, HEAD, WIDER = 256, 4096, 4
SLACK = 1e-6
STEP = 1024
INT64 = np.iinfo(np.int64)


def integer_rows(vectors: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """(id, label, v): rows that take part, with v the integers floor(256 x)."""
    x = F.transform(vec, lambda c: c.cast("double"))
    fine = F.col(vec).isNotNull() & F.col(label).isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    # the floor as a double, exact at any size
    floor = lambda c: F.when(F.abs(c * SCALE) < 2.0**52, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.transform(x, floor).alias("v"), fine.alias("_fine")).filter("_fine and id is not null").drop("_fine")


def _fold(dims: int, n: int):
    """Of the rows of a batch with the same label and vector those with the ``n`` least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            whole = np.ascontiguousarray(np.column_stack((label, matrix(batch.column("v"), dims).view(np.int64))))
            _, same = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 8))).ravel(), return_inverse=True)
            order = np.lexsort((ids, same))
            order = order[np.concatenate(([True], (np.diff(ids[order]) != 0) | (np.diff(same[order]) != 0)))[: len(order)]]
            nth = np.arange(len(order)) - np.searchsorted(same[order], same[order])
            yield batch.take(pa.array(order[nth < n]))

    return run


def _first_ids(rows: DataFrame, dims: int, n: int) -> DataFrame:
    """Rows whose id is among the ``n`` least of those with the same label and vector; a repeated id counts once.

    Folded in each batch and salted, so that a third of all rows with one
    vector meets in no single task.
    """
    few = rows.select("id", "label", "v").mapInArrow(_fold(dims, n), "id bigint, label bigint, v array<double>")
    salted = few.groupBy("label", "v", F.pmod(F.xxhash64("id"), F.lit(256)).alias("_salt")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, n).alias("ids"))
    merged = salted.groupBy("label", "v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, n).alias("ids"))
    return merged.select(F.explode("ids").alias("id"), "label", "v")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond 64 bits they stand at the end of the range."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, INT64.min, INT64.max).astype(np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def units(x: np.ndarray) -> np.ndarray:
    n = norms(x)
    return np.where(n[:, None] > 0, x / np.where(n > 0, n, 1)[:, None], np.eye(1, x.shape[1]))


def fit_centres(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """``k`` unit vectors from spherical k-means."""
    x, rng = units(x), np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        centres = np.where(norms(sums)[:, None] > 0, units(sums), centres)
    return centres


@dataclass
class Lists:
    """The shared lists: centres, the widest angle of each cluster, and the histogram of bounds."""

    centres: np.ndarray
    wide: np.ndarray
    top: float
    counts: np.ndarray | None = None

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For every candidate and cluster the bound for an anchor of norm 1."""
        theta = np.arccos(np.clip(units(x) @ self.centres.T, -1, 1))
        return norms(x)[:, None] * np.cos(np.maximum(0, theta - self.wide)) + SLACK * self.top

    def bins(self, bound: np.ndarray) -> np.ndarray:
        """Bin 0 holds the highest bounds."""
        return np.clip(((1 - bound / (self.top * (1 + 2 * SLACK) + SLACK)) / 2 * BINS).astype(np.int64), 0, BINS - 1)

    def edge(self, b: np.ndarray) -> np.ndarray:
        """No bound in bin ``b`` or later is above this."""
        return (1 - 2 * np.asarray(b) / BINS) * (self.top * (1 + 2 * SLACK) + SLACK) + SLACK * self.top


def _histogram(lists: Lists, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(lists.centres)
        counts = np.zeros((k, BINS), np.int64)
        for batch in batches:
            if batch.num_rows:
                at = lists.bins(lists.bounds(matrix(batch.column("v"), dims))) + np.arange(k) * BINS
                counts += np.bincount(at.ravel(), minlength=k * BINS).reshape(k, BINS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts.ravel()[some])], ["cell", "n"])

    return run


def _band(lists: Lists, dims: int, low: np.ndarray, high: np.ndarray):
    """Blocks of the candidates whose bin lies in [low, high) of a cluster, sorted by bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), dims)
            bound = lists.bounds(x)
            at = lists.bins(bound)
            ids, label = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            short = np.int16 if np.abs(x).max() < 2**15 else np.float64
            for c in np.flatnonzero(high > low):
                inside = np.flatnonzero((at[:, c] >= low[c]) & (at[:, c] < high[c]))
                if len(inside):
                    inside = inside[np.argsort(-bound[inside, c], kind="stable")]
                    parts = (ids[inside], label[inside], bound[inside, c], x[inside].astype(short))
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["cluster", "c_ids", "c_labels", "c_bounds", "c_flat"])

    return run


BLOCK = "cluster int, c_ids binary, c_labels binary, c_bounds binary, c_flat binary"


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best: high scores first, ties by smaller id."""
    return np.lexsort((ids, -score))[:k]


def _windows(score: np.ndarray, ids: np.ndarray, tops: np.ndarray, k: int, share: int) -> list[np.ndarray]:
    """For each score in ``tops`` the positions of the ``k`` best between ``share`` percent of it and itself."""
    order = np.lexsort((ids, -score))
    falling = -score[order]
    found = []
    for top in tops:
        some = order[np.searchsorted(falling, -top, side="left"):][:k]
        found.append(some[100 * score[some] >= share * top])
    return found


def _walk(dims: int, k: int, share: int | None):
    """Anchors of a part walk one block; entries that may enter an anchor's results come out."""

    def positives(score, ids, floor):
        some = np.flatnonzero(score >= floor)
        return [(0, some[_best(score[some], ids[some], k)])]

    def negatives(score, ids, floor, tops):
        some = np.flatnonzero((score >= floor) & (score <= tops[0]))
        return [(j, some[w]) for j, w in enumerate(_windows(score[some], ids[some], tops, k, share))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, label, bound = (np.frombuffer(row[c], t) for c, t in (("c_ids", np.int64), ("c_labels", np.int64), ("c_bounds", np.float64)))
                x = np.frombuffer(row["c_flat"], np.int16 if len(row["c_flat"]) == 2 * dims * len(ids) else np.float64).reshape(-1, dims).astype(np.float64)
                q = matrix(pa.array(row["v"], pa.list_(pa.float64())), dims)
                own, floor = np.array(row["label"]), np.array(row["floor"], np.int64)
                length = norms(q) + SLACK
                # walked this far at most: the bound of all later candidates is below the floor
                reach = np.array([np.searchsorted(-(bound * n), -float(f), side="right") for n, f in zip(length, floor)], np.int64)
                out = []
                for lo in range(0, int(reach.max(initial=0)), STEP):
                    live = np.flatnonzero(reach > lo)
                    score = products(q[live], x[lo: lo + STEP])
                    same = own[live][:, None] == label[None, lo: lo + STEP]
                    for i, s, m in zip(live, score, same):
                        seen = np.flatnonzero(m if share is None else ~m)
                        near = ids[lo: lo + STEP][seen]
                        picked = positives(s[seen], near, floor[i]) if share is None else negatives(s[seen], near, floor[i], np.array(row["tops"][i], np.int64))
                        for j, at in picked:
                            out += [(row["anchor"][i], j, int(v), int(n)) for v, n in zip(s[seen][at], near[at])]
                        if share is None and len(picked[0][1]) == k:
                            floor[i] = max(floor[i], s[seen][picked[0][1][-1]])
                            reach[i] = min(reach[i], np.searchsorted(-(bound * length[i]), -float(floor[i]), side="right"))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["anchor", "slot", "score", "id"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _walks(placed: DataFrame, rows: DataFrame, lists: Lists, dims: int, k: int, share: int | None) -> DataFrame:
    """(anchor, slot, score, id, rank): all anchors of ``placed`` walk their lists, band by band.

    ``placed`` has anchor, cluster, part, label, v, norm and tops, the scores
    under which slots are filled (the first walk has one slot without limit).
    """
    kind = "anchor bigint, slot int, score bigint, id bigint"
    clusters = len(lists.centres)
    walked = np.zeros(clusters, np.int64)  # bins done
    before = np.cumsum(lists.counts, axis=1)
    length = HEAD
    done = placed.sparkSession.createDataFrame([], f"{kind}, rank int")
    lowest = F.lit(int(INT64.min))
    while True:
        # what an entry must reach: the worst of a full slot, and the share of the slot's own limit
        if share is None:
            floors = done.filter(F.col("rank") == k).select(F.col("anchor").alias("_a"), F.col("score").alias("floor"))
            asking = placed.join(floors, placed["anchor"] == floors["_a"], "left").withColumn("floor", F.coalesce("floor", lowest)).drop("_a")
        else:
            full = done.filter(F.col("rank") == k).groupBy(F.col("anchor").alias("_a")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("_full"))
            # below zero the share of a score lies above it: nothing fits
            least = lambda t, j: F.when(t < 0, F.lit(int(INT64.max))).otherwise(F.greatest(F.ceil(t.cast("decimal(38,0)") * share / 100).cast("long"), F.coalesce(F.col("_full")[j], lowest)))
            asking = placed.join(full, placed["anchor"] == full["_a"], "left").withColumn("floor", F.array_min(F.transform("tops", least))).drop("_a", "_full")
        # an anchor goes on while the next bin may hold a score of its floor
        edges = F.array(*(F.lit(float(e)) for e in lists.edge(walked)))
        asking = stage(asking.filter(edges[F.col("cluster")] * (F.col("norm") + SLACK) >= F.col("floor")), "asking")
        need = {r["cluster"]: r["least"] for r in asking.groupBy("cluster").agg(F.min(F.col("floor") / (F.col("norm") + SLACK)).alias("least")).collect()}
        low, high = walked, walked.copy()
        for c, least in need.items():
            if walked[c] < BINS:
                past = before[c, walked[c] - 1] if walked[c] else 0
                last = int(np.searchsorted(before[c], past + length)) + 1
                deep = int(np.count_nonzero(lists.edge(np.arange(BINS)) >= least))  # no anchor needs a later bin
                high[c] = min(BINS, max(walked[c] + 1, min(last, deep)))
        if not (high > low).any():
            return done
        parts = asking.groupBy("cluster", "part").agg(*(F.collect_list(c).alias(c) for c in ("anchor", "label", "v", "floor", "tops")))
        blocks = rows.mapInArrow(_band(lists, dims, low, high), BLOCK)
        met = blocks.join(parts.drop("part"), "cluster")
        found = met.mapInArrow(_walk(dims, k, share), kind)
        done = stage(_top(found.unionByName(done.drop("rank")), k), "walked")
        walked, length = high, length * WIDER


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, share: int = 80, seed: int = 42,
    id_col: str = "vec_id", vec: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` holds ids of ``vectors`` in a column of the same name. Scores
    are inner products of the integers floor(256 x). Positives of an anchor are
    the ``positives`` best other rows of its label; for each, the ``negatives``
    best rows of other labels with scores between ``share`` percent of the
    positive's and the positive's own follow. Ties go to the smaller id. The
    result is exact.

    Rows with a null id, label, vector or component, or a component that isn't
    finite, take no part. Shorter vectors end in zeros. Of rows with the same
    id, label and vector one counts; rows of one id that differ are candidates
    each, and anchors each. No anchors or no candidates give no rows. Labels
    are whole numbers. Clusters are fitted on ``FIT_ROWS`` distinct anchors at
    most, taken in the order of a hash; all anchors and rows take part.
    """
    rows = integer_rows(vectors, id_col, vec, label).withColumn("label", F.col("label").cast("long"))
    asked = stage(rows.join(anchors.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi").distinct(), "anchors")
    # anchors of one label and vector differ only in leaving themselves out: they walk once, for one positive more
    groups = asked.groupBy("label", "v").agg(F.min("id").alias("anchor"))
    # ids of one label are unique per group unless one id comes with several vectors; the hash of the vector tells those apart
    groups = stage(groups.select(F.xxhash64("anchor", "label", "v").alias("anchor"), "label", "v"), "anchor-groups")
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("top")).first()
    dims, spark = max(1, size["dims"] or 0), vectors.sparkSession
    schema = f"anchor_id {vectors.schema[id_col].dataType.simpleString()}, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if groups.isEmpty():
        return spark.createDataFrame([], schema)
    keep = stage(_first_ids(rows, dims, max(positives + 1, negatives)), "candidates")
    # a bounded sample: FIT_ROWS vectors reach the driver
    drawn = groups.orderBy(F.xxhash64("anchor", F.lit(seed))).limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()
    centres = fit_centres(matrix(drawn, dims), min(CLUSTERS, max(1, len(drawn) // 64)), seed)

    @F.pandas_udf("cluster int, theta double, norm double")
    def nearest(v):
        import pandas as pd

        x = matrix(pa.array(v, pa.list_(pa.float64())), dims)
        cos = units(x) @ centres.T
        return pd.DataFrame({"cluster": cos.argmax(axis=1).astype("int32"), "theta": np.arccos(np.clip(cos.max(axis=1), -1, 1)), "norm": norms(x)})

    homes = stage(groups.withColumn("_h", nearest("v")).select("anchor", "label", "v", "_h.*"), "homes")
    spread = {r["cluster"]: (r["wide"], r["n"]) for r in homes.groupBy("cluster").agg(F.max("theta").alias("wide"), F.count("*").alias("n")).collect()}
    used = sorted(spread)  # clusters without anchors need no list
    number = F.create_map(*(F.lit(v) for i, c in enumerate(used) for v in (c, i)))
    parts = F.create_map(*(F.lit(v) for c in used for v in (c, -(-spread[c][1] // PART))))
    part = F.pmod(F.xxhash64("anchor"), parts[F.col("cluster")])
    lists = Lists(centres[used], np.array([spread[c][0] for c in used]) + SLACK, float(np.sqrt(size["top"])))
    hist = keep.mapInArrow(_histogram(lists, dims), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # CLUSTERS * BINS rows at most
    lists.counts = np.zeros((len(used), BINS), np.int64)
    for r in hist:
        lists.counts.flat[r["cell"]] = r["n"]
    placed = homes.select("anchor", number[F.col("cluster")].alias("cluster"), part.alias("part"), "label", "v", "norm")

    near = _walks(placed.withColumn("tops", F.array().cast("array<bigint>")), keep, lists, dims, positives + 1, None)
    tops = near.groupBy("anchor").agg(F.reverse(F.array_sort(F.collect_set("score"))).alias("tops"))
    below = _walks(placed.join(tops, "anchor"), keep, lists, dims, negatives, share)
    slots = tops.select("anchor", F.posexplode("tops").alias("slot", "score"))

    # every anchor of a group leaves itself out
    named = asked.join(groups.withColumnRenamed("anchor", "group"), ["label", "v"]).select(F.col("id").alias("anchor_id"), "group")
    own = named.join(near.select(F.col("anchor").alias("group"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("_r")), "group")
    own = own.filter("anchor_id != positive_id").withColumn("_nth", F.row_number().over(W.partitionBy("group", "anchor_id").orderBy("_r"))).filter(F.col("_nth") <= positives)
    own = own.join(slots.select(F.col("anchor").alias("group"), "slot", F.col("score").alias("positive_score")), ["group", "positive_score"])
    bad = below.select(F.col("anchor").alias("group"), "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = own.join(bad, ["group", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
