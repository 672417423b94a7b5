"""Hard negatives by one-dimensional distance keys.

The score of a row x for an anchor q is the integer inner product of their quantised vectors. With M the largest
squared length of all rows, x is augmented to (x, sqrt(M - |x|**2)) and q to (q, 0): then |q' - x'|**2 = M + |q|**2 -
2 q.x, and the highest scores are the nearest rows. Every row is stored under the key (label, pivot, distance to the
pivot), for the nearest of a few pivots; the rows in the order of this key are cut into blocks, each an interval of
keys. By the triangle inequality a row with key k and pivot p lies no nearer to q' than |k - |q' - p|| and no farther
than k + |q' - p|.

Anchors are searched for in groups of one label. A first scan takes the blocks whose keys meet those of the group under
its own pivots; the scores found so far give the distance within which anything better must lie, and a second one
takes the annuli of that width under all pivots, nearest blocks first. An anchor leaves out a block that its bound
excludes, and its bound tightens with every block: its search ends when no block left can hold a better row.
Where vectors spread evenly over many directions these bounds exclude little, and every anchor meets every block of
the labels it is searched for in, by matrix products on blocks of bounded size.

Positives are the first rows of the anchor's label, negatives the first rows of other labels with a score in a band
below the positive's. Rows with a null id, label or vector or with a null or non-finite component take no part; rows
with vectors of another length are never partners. Every row with an anchor's id is an anchor of its own and no row
with that id is its positive; otherwise rows that repeat an id are further rows. Equal scores go by the smaller id.
Squared lengths of quantised vectors must be below 2**53, so that scores are exact in doubles (an error otherwise). An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.store import materialise, release

#: Pivots, vectors they are chosen from (this decides what work is skipped, not what is found).
PIVOTS, SAMPLE = 16, 4_000
#: Rows of a block, anchors of a group, blocks that one task meets with a group.
BLOCK, GROUP, MEETS = 4_096, 1_024, 64
#: Relative error allowed for in distances.
_SLACK = 1e-9


def pivots(sample: np.ndarray, most: float, n: int = PIVOTS) -> np.ndarray:
    """Rows of the augmented sample, each the farthest from those before it."""
    x = augmented(sample, most)
    chosen = [x.mean(axis=0)]
    far = ((x - chosen[0]) ** 2).sum(axis=1)
    for _ in range(min(n, len(x)) - 1):
        chosen.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))])


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((x[:, None, :] - p[None, :, :]) ** 2).sum(axis=2))) if len(x) < 512 else np.vstack([_distances(x[k : k + 511], p) for k in range(0, len(x), 511)])


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each, after that number of bytes."""
    top = int(np.abs(x).max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w - 1)
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1)


class Scan:
    """The best rows of a group's anchors so far: for each anchor and band the ``k`` highest scores within it."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, most: float, points: np.ndarray, others: bool):
        self.x, self.ids, self.k, self.most, self.others = vectors.astype(np.float64), ids, k, most, others
        self.lo, self.hi = lo, hi
        self.norm = (self.x**2).sum(axis=1)
        self.away = _from_pivots(vectors, points)
        self.score = np.full((*lo.shape, k), -np.inf)
        self.id = np.full((*lo.shape, k), (1 << 63) - 1, np.int64)
        self.met = 0

    def needed(self) -> np.ndarray:
        """For each anchor the least score that can still enter; infinite if none can."""
        return np.maximum(self.lo, self.score[:, :, -1]).min(axis=1)

    def meet(self, pivot: int, lo: float, hi: float, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take in a block with keys from ``lo`` to ``hi``."""
        away, whole = self.away[:, pivot], self.most + self.norm
        near = np.maximum(0.0, np.maximum(lo - away, away - hi) - _SLACK * (1 + away + hi))
        least = (whole - ((away + hi) * (1 + _SLACK)) ** 2) / 2
        own = np.flatnonzero(((whole - near * near) / 2 * (1 + _SLACK) + 1 >= self.needed()) & (least - 1 <= self.hi.max(axis=1)))
        if not len(own):
            return
        self.met += len(own)
        score = self.x[own] @ rows.astype(np.float64).T
        if self.others:
            score[self.ids[own][:, None] == ids[None, :]] = -np.inf
        for j in range(self.lo.shape[1]):
            self._keep(own, j, ids, score)

    def _keep(self, own: np.ndarray, j: int, ids: np.ndarray, score: np.ndarray) -> None:
        k = self.k
        floor = np.maximum(self.lo[own, j], self.score[own, j, -1])
        found = np.where((score >= floor[:, None]) & (score <= self.hi[own, j][:, None]), score, -np.inf)
        if found.shape[1] > k:
            floor = np.partition(found, -k, axis=1)[:, -k]
        r, c = np.nonzero((found > -np.inf) & (found >= floor[:, None]))
        if not len(r):
            return
        row = np.concatenate([np.repeat(np.arange(len(own)), k), r])
        value = np.concatenate([self.score[own, j].ravel(), found[r, c]])
        name = np.concatenate([self.id[own, j].ravel(), ids[c]])
        order = np.lexsort((name, -value, row))
        first = np.searchsorted(row[order], np.arange(len(own)))
        best = order[first[:, None] + np.arange(k)]
        self.score[own, j], self.id[own, j] = value[best], name[best]

    def rows(self) -> tuple[np.ndarray, ...]:
        """slot, band, id and score of what was found."""
        slot, band, place = np.nonzero(self.score > -np.inf)
        return slot, band, self.id[slot, band, place], self.score[slot, band, place].astype(np.int64)


def _from_pivots(anchors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of the augmented anchors from the pivots."""
    return _distances(np.column_stack([anchors.astype(np.float64), np.zeros(len(anchors))]), points)


def _own(points, dim: int) -> np.ndarray:
    """Pivots of vectors of this length; the origin where the sample has none."""
    found = points.value.get(dim)
    return found if found is not None else np.zeros((1, dim + 1))


def _matrix(data: bytes, rows: int) -> np.ndarray:
    x = _unpacked(data)
    return x.reshape(rows, len(x) // max(1, rows))


def _place(points, most: float):
    """Nearest pivot of each row and the distance to it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(2).to_pylist(), np.int64)
            pivot, key = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                x = np.array(batch.column(3).take(pa.array(rows)).to_pylist(), np.float64).reshape(len(rows), d)
                away = _distances(augmented(x, most), _own(points, d))
                pivot[rows], key[rows] = away.argmin(axis=1), away.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(key)], [*batch.schema.names, "pivot", "key"])

    return place


def _cut(rows: int, by_pivot: bool):
    """Blocks of neighbouring rows of a label, and of a pivot if ``by_pivot``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, kind, held = TaskContext.get().partitionId() << 32, None, []

        def close() -> pa.RecordBatch:
            nonlocal serial
            row = {"block": serial, "g": kind[0], "dim": kind[1], "pivot": kind[2], "lo": min(h[2] for h in held), "hi": max(h[2] for h in held), "ids": [h[0] for h in held], "data": _packed(np.array([h[1] for h in held], np.int64))}
            serial += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=_BLOCKS_ARROW)

        for batch in batches:
            for i, g, dim, q, _, pivot, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = (g, dim, pivot if by_pivot else -1)
                if held and (now != kind or len(held) >= rows):
                    yield close()
                kind = now
                held.append((i, q, key))
        if held:
            yield close()

    return cut


def _reach(points):
    """Least and largest distance of a group's anchors from each pivot, and whether it is the nearest of one of them."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, dim, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                away = _from_pivots(_matrix(data, len(ids)), _own(points, dim))
                n = away.shape[1]
                home = np.isin(np.arange(n), away.argmin(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([group] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(away.min(axis=0)), pa.array(away.max(axis=0)), pa.array(home)], ["group", "pivot", "near", "far", "home"])

    return reach


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = _matrix(data, len(ids)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(x), pa.int64()), pa.array(range(len(x)), pa.int32()), pa.array((x * x).sum(axis=1))], ["group", "slot", "norm"])


def _meet(points, most: float, k: int, n_bands: int, others: bool):
    """Rows of a group: first its own, then its blocks."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, group = None, None

        def close() -> pa.RecordBatch:
            slot, band, ids, score = scan.rows()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), group, np.int64)), pa.array(slot.astype(np.int32)), pa.array(band.astype(np.int32)), pa.array(ids), pa.array(score)], ["group", "slot", "band", "id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(n)[r].as_py() for n, c in enumerate(batch.schema.names)}
                ids = np.array(row["ids"], np.int64)
                x = _matrix(row["data"], len(ids))
                if row["bands"] is None:
                    scan.meet(row["pivot"], row["lo"], row["hi"], ids, x)
                    continue
                if scan is not None:
                    yield close()
                group = row["group"]
                lo, hi = np.full((len(ids), n_bands), np.inf), np.full((len(ids), n_bands), -np.inf)
                for b in row["bands"]:
                    lo[b["slot"], b["band"]], hi[b["slot"], b["band"]] = b["lo"], b["hi"]
                scan = Scan(x, ids, lo, hi, k, most, _own(points, row["dim"]), others)
        if scan is not None:
            yield close()
        release()

    return meet


class Index:
    """Blocks of all rows and groups of the anchors, both written in the shared folder."""

    def __init__(self, vectors: DataFrame, anchor: Column, id: str, label: str, vector: str, scale: int, block: int, group: int):
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        rows = vectors.select(F.col(id).cast("long").alias("i"), F.col(label).cast("string").alias("g"), F.col(vector).cast("array<double>").alias("v"), anchor.alias("anchor"))
        rows = rows.where(F.col("i").isNotNull() & F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
        rows = materialise(rows.select("i", "g", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * scale)).alias("q"), F.coalesce("anchor", F.lit(False)).alias("anchor"), F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double")).alias("norm")), "quantised")
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("norm"), F.lit(0.0)).alias("most"), F.sum(F.col("anchor").cast("int")).alias("anchors")).first()
        self.most = size.most
        if self.most >= 2**53:
            raise ValueError("squared lengths of quantised vectors must be below 2**53")
        sample: dict[int, list] = {}
        for r in rows.orderBy(F.xxhash64("i"), "i").limit(SAMPLE).select("dim", "q").collect():
            sample.setdefault(r.dim, []).append(r.q)
        self.points = rows.sparkSession.sparkContext.broadcast({d: pivots(np.array(q), self.most) for d, q in sample.items()})
        placed = rows.drop("norm").mapInArrow(_place(self.points, self.most), "i long, g string, dim int, q array<long>, anchor boolean, pivot int, key double")
        keys = ["g", "dim", "pivot", "key", "i"]
        placed = materialise(placed, "placed")
        laid = placed.repartitionByRange(max(1, -(-size.n // (4 * block))), *keys).sortWithinPartitions(*keys)
        self.blocks = materialise(laid.mapInArrow(_cut(block, True), _BLOCKS), "blocks")
        some = placed.where("anchor").repartitionByRange(max(1, -(-(size.anchors or 0) // (4 * group))), *keys).sortWithinPartitions(*keys)
        self.groups = materialise(some.mapInArrow(_cut(group, False), _BLOCKS), "groups")
        self.reach = materialise(self.groups.select("block", "dim", "ids", "data").mapInArrow(_reach(self.points), "group long, pivot int, near double, far double, home boolean"), "reach").join(self.groups.select(F.col("block").alias("group"), "g", "dim"), "group")
        self.anchors = self.groups.select(F.col("block").alias("group"), F.posexplode("ids").alias("slot", "i"))
        self.n_blocks = max(1, -(-size.n // block))

    def best(self, k: int, bands: DataFrame, n_bands: int, same_label: bool) -> DataFrame:
        """group, slot, band, rank, id and score: for each of ``bands`` (group, slot, band, lo, hi) the ``k`` first rows of
        the anchor's label, or of all others, with a score from lo to hi."""
        bands = materialise(bands, "bands")
        label = F.col("g") == F.col("g_b") if same_label else F.col("g") != F.col("g_b")
        met = self.blocks.select("block", F.col("g").alias("g_b"), F.col("dim").alias("dim_b"), F.col("pivot").alias("pivot_b"), "lo", "hi")
        on = [F.col("dim") == F.col("dim_b"), F.col("pivot") == F.col("pivot_b"), label]
        meet = functools.reduce(lambda a, b: a & b, on)
        gap = F.greatest(F.lit(0.0), F.col("lo") - F.col("far"), F.col("near") - F.col("hi"))
        asked = self.reach.join(bands.select("group").distinct(), "group", "left_semi")
        first = asked.where("home").join(met, meet & (gap == 0)).select("group", "block", gap.alias("gap"))
        held = self._scan(first, bands, k, n_bands, same_label)
        # the distance within which whatever is still missing lies
        last = held.groupBy("group", "slot", "band").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        tight = bands.join(last, ["group", "slot", "band"], "left")
        full = F.col("n") >= k
        tight = materialise(tight.select("group", "slot", "band", F.when(full, F.greatest("lo", F.col("least").cast("double"))).otherwise(F.col("lo")).alias("lo"), "hi"), "tight")
        size = self.groups.select("block", "ids", "data").mapInArrow(_norms, "group long, slot int, norm double")
        wide = tight.join(size, ["group", "slot"]).groupBy("group").agg(F.max(F.sqrt(F.greatest(F.lit(0.0), self.most + F.col("norm") - 2 * F.col("lo")))).alias("radius"))
        rest = self.reach.join(wide, "group").join(met, meet & (gap <= F.col("radius") * (1 + 1e-6) + 1e-6) & ~(F.col("home") & (gap == 0)))
        more = self._scan(rest.select("group", "block", gap.alias("gap")), tight, k, n_bands, same_label)
        order = Window.partitionBy("group", "slot", "band").orderBy(F.desc("score"), "id")
        return held.unionAll(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _scan(self, pairs: DataFrame, bands: DataFrame, k: int, n_bands: int, same_label: bool) -> DataFrame:
        """Meet each group with its blocks, ``MEETS`` of them a task or so, the nearest first."""
        shares = max(1, -(-self.n_blocks // MEETS))
        pairs = materialise(pairs.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares))), "pairs")
        asked = bands.groupBy("group").agg(F.collect_list(F.struct("slot", "band", "lo", "hi")).alias("bands"))  # at most GROUP x n_bands
        heads = pairs.select("group", "share").distinct().join(self.groups.withColumnRenamed("block", "group").drop("pivot", "lo", "hi", "g"), "group").join(asked, "group")
        heads = heads.select("group", "share", F.lit(-1.0).alias("gap"), "dim", F.lit(-1).alias("pivot"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), "ids", "data", "bands")
        none = F.lit(None).cast(heads.schema["bands"].dataType)
        tails = pairs.join(self.blocks.drop("g"), "block").select("group", "share", "gap", "dim", "pivot", "lo", "hi", "ids", "data", none.alias("bands"))

        work = heads.unionAll(tails).repartition("group", "share").sortWithinPartitions("group", "share", "gap")
        return materialise(work.mapInArrow(_meet(self.points, self.most, k, n_bands, same_label), "group long, slot int, band int, id long, score long"), "found")


_BLOCKS = "block long, g string, dim int, pivot int, lo double, hi double, ids array<long>, data binary"
_BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("g", pa.string()), ("dim", pa.int32()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.list_(pa.int64())), ("data", pa.binary())])


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), scale: int = 256, id: str = "vec_id", label: str = "label", vector: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row where ``anchor`` holds and
    each of its first ``positives`` the first ``negatives`` whose score is from band[0] to band[1] percent of the
    positive's. ``block``, ``group``: rows of a block and a group."""
    index = Index(vectors, anchor, id, label, vector, scale, block, group)
    every = index.anchors.select("group", "slot", F.lit(0).alias("band"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    first = index.best(positives, every, 1, True).select("group", "slot", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    first = materialise(first, "positives")
    # exact bounds in whole numbers: the least n with 100 n >= p s, the largest with 100 n <= p s
    exact = first.select("group", "slot", "band", F.expr(f"CAST(-((-positive_score * {band[0]} - pmod(-positive_score * {band[0]}, 100)) div 100) AS DOUBLE)").alias("lo"), F.expr(f"CAST((positive_score * {band[1]} - pmod(positive_score * {band[1]}, 100)) div 100 AS DOUBLE)").alias("hi"))
    found = index.best(negatives, exact.where("lo <= hi"), positives, False)
    out = found.join(first, ["group", "slot", "band"]).join(index.anchors, ["group", "slot"])
    return out.select(F.col("i").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
