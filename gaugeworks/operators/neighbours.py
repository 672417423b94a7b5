"""Nearest-neighbour joins and vector models: memory banks, Gaussians, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of bank vectors up to which the whole bank is broadcast, and of a block of a larger one; rows of a block of queries.
BANK_BYTES, QUERY_ROWS = 64 << 20, 4_096
#: Distances held at once by a task.
TILE = 1 << 22
#: Vectors of up to so many components, in banks from so many rows on, are met by boxes; about the rows of a box, rows of a block of queries, and queries that a task gathers.
BOX_DIMS, BOX_LEAST, BOX_ROWS, BOX_BLOCK, BOX_QUERIES = 16, 8_192, 1_024, 512, 1 << 17


def squared_distances(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (q @ b.T)
    return np.maximum(d, 0.0)


def _nearest(q: np.ndarray, own: np.ndarray, bank: np.ndarray, ids: np.ndarray, k: int, per: int | None) -> tuple[np.ndarray, ...]:
    """Row, bank position, distance and rounded distance of at least the k nearest, ties by bank id.

    One matrix product bounds the k-th distance; what may lie within it is measured exactly."""
    qq, bb = (q * q).sum(1), (bank * bank).sum(1)
    d = np.hstack([q, qq[:, None], np.ones((len(q), 1))]) @ np.hstack([-2.0 * bank, np.ones((len(bank), 1)), bb[:, None]]).T
    if per:  # ids are in order, so what shares a quotient lies together
        group = ids // per
        for r, (lo, hi) in enumerate(zip(np.searchsorted(group, own // per), np.searchsorted(group, own // per, "right"), strict=True)):
            d[r, lo:hi] = np.inf
    m = min(k, len(bank))
    kth = d.min(1) if m == 1 else np.partition(d, m - 1, axis=1)[:, m - 1]
    slack = 1e-12 * (qq + bb.max())
    within = (np.sqrt(np.maximum(kth, 0.0) + slack) + 2e-9) ** 2 + slack
    rows, cols = np.nonzero((d <= within[:, None]) & (d < np.inf))
    exact = np.concatenate([np.sqrt(((q[rows[a : a + 65536]] - bank[cols[a : a + 65536]]) ** 2).sum(1)) for a in range(0, len(rows), 65536)] or [np.empty(0)])
    near = np.round(exact, 9)  # so that equal distances tie in spite of rounding
    order = np.lexsort((cols, near, rows))
    rows = rows[order]
    top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    first = order[top]
    return rows[top], cols[first], exact[first], near[first]


class _Boxes:
    """A bank of short vectors halved at medians into boxes; a query meets the boxes that may hold one of its nearest."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, per: int | None):
        order, edges = np.arange(len(ids)), np.array([0, len(ids)])
        self.cuts: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids) // (len(edges) - 1) > BOX_ROWS:
            axis, at = np.zeros(len(edges) - 1, np.int64), np.zeros(len(edges) - 1)
            middles = (edges[:-1] + edges[1:]) // 2
            for b, (lo, mid, hi) in enumerate(zip(edges, middles, edges[1:], strict=False)):
                own = vectors[order[lo:hi]]
                axis[b] = (own.max(0) - own.min(0)).argmax()
                part = np.argpartition(own[:, axis[b]], mid - lo)
                order[lo:hi], at[b] = order[lo:hi][part], own[part[mid - lo], axis[b]]
            self.cuts.append((axis, at))
            edges = np.sort(np.concatenate([edges, middles]))
        self.edges, self.vectors, self.ids, self.per = edges, vectors[order], ids[order], per
        self.low, self.high = np.minimum.reduceat(self.vectors, edges[:-1]), np.maximum.reduceat(self.vectors, edges[:-1])
        self._derive()

    def _derive(self) -> None:
        bb = (self.vectors**2).sum(1)
        self.largest = bb.max()
        self.lifted = np.ascontiguousarray(np.hstack([-2.0 * self.vectors, np.ones((len(bb), 1)), bb[:, None]]).T)
        if self.per:
            self.wholes = np.argsort(self.ids // self.per, kind="stable")
            self.sorted = (self.ids // self.per)[self.wholes]

    def __getstate__(self) -> dict:  # what can be derived does not travel
        return {k: v for k, v in vars(self).items() if k not in ("largest", "lifted", "wholes", "sorted")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._derive()

    def box_of(self, q: np.ndarray) -> np.ndarray:
        box = np.zeros(len(q), np.int64)
        for axis, at in self.cuts:
            box = 2 * box + (q[np.arange(len(q)), axis[box]] >= at[box])
        return box

    def _apart(self, own: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By box, the queries and positions of the bank that belong to one whole."""
        if not self.per:
            return {}
        lo, hi = (np.searchsorted(self.sorted, own // self.per, side) for side in ("left", "right"))
        n = hi - lo
        row = np.repeat(np.arange(len(own)), n)
        at = self.wholes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]]
        box = np.searchsorted(self.edges, at, "right") - 1
        order = np.argsort(box, kind="stable")
        found, first = np.unique(box[order], return_index=True)
        return {b: (row[o], at[o]) for b, o in zip(found.tolist(), np.split(order, first[1:]), strict=True)} if len(found) else {}

    def _block(self, q: np.ndarray, own: np.ndarray, k: int) -> pd.DataFrame:
        """As :func:`_nearest`: squared distances by matrix products bound the k-th, what may lie within it is measured exactly."""
        qq = (q * q).sum(1)
        least = np.zeros((len(q), len(self.low)))  # squared distance from each box
        for c in range(q.shape[1]):
            gap = np.maximum(self.low[:, c] - q[:, c, None], q[:, c, None] - self.high[:, c])
            np.maximum(gap, 0.0, out=gap)
            least += gap * gap
        slack = 1e-12 * (qq + self.largest)
        lifted = np.hstack([q, qq[:, None], np.ones((len(q), 1))])
        best, within = np.full((len(q), k), np.inf), np.full(len(q), np.inf)
        apart, held = self._apart(own), []
        boxes, step = np.argsort(least.sum(0)), 8
        while len(boxes):
            now, boxes = boxes[:step].tolist(), boxes[step:]
            for b in now:
                rows = np.flatnonzero(least[:, b] <= within)
                if not len(rows):
                    continue
                lo = self.edges[b]
                d = lifted[rows] @ self.lifted[:, lo : self.edges[b + 1]]
                if b in apart:
                    row, at = apart[b]
                    place = np.minimum(np.searchsorted(rows, row), len(rows) - 1)
                    same = rows[place] == row
                    d[place[same], at[same] - lo] = np.inf
                near = np.flatnonzero(d.min(1) <= within[rows])
                rows, d = rows[near], d[near]
                best[rows] = np.partition(np.hstack([best[rows], d]), k - 1, axis=1)[:, :k]
                within[rows] = (np.sqrt(np.maximum(best[rows].max(1), 0.0) + slack[rows]) + 2e-9) ** 2 + slack[rows]
                r, c = np.nonzero((d <= within[rows, None]) & (d < np.inf))
                held.append((rows[r], c + lo, d[r, c]))
            boxes, step = boxes[(least[:, boxes] <= within[:, None]).any(0)], 2 * step
        rows, cols, d = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        kept = d <= within[rows]
        rows, cols = rows[kept], cols[kept]
        exact = np.sqrt(((q[rows] - self.vectors[cols]) ** 2).sum(1))
        near, ids = np.round(exact, 9), self.ids[cols]  # so that equal distances tie in spite of rounding
        order = np.lexsort((ids, near, rows))
        top = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order]) < k
        first = order[top]
        return pd.DataFrame({"i": own[rows[first]], "neighbour": ids[first], "distance": exact[first], "near": near[first]})

    def met(self, q: np.ndarray, own: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
        order = np.argsort(self.box_of(q), kind="stable")  # queries of a block lie near each other
        for at in range(0, len(order), BOX_BLOCK):
            part = order[at : at + BOX_BLOCK]
            yield self._block(q[part], own[part], min(k, len(self.ids)))


def _boxes(vectors: np.ndarray, ids: np.ndarray, per: int | None) -> _Boxes | None:
    return _Boxes(vectors, ids, per) if len(ids) >= BOX_LEAST and vectors.shape[1] <= BOX_DIMS else None


def knn_join(queries: DataFrame, bank: DataFrame, k: int, id: str, vector: str, bank_id: str | None = None, exclude_self: bool = False, limit: int = BANK_BYTES, per: int = 1) -> DataFrame:
    """(id, rank, neighbour, distance) of the k nearest bank vectors, ties by bank id; k is clamped to the bank.

    A bank of up to ``limit`` counted bytes comes whole to the queries. A larger one is dealt into blocks of that size, each a row,
    and every block of queries meets every block of the bank in a join; no vector passes the driver. Of large banks of short
    vectors only the boxes that may hold a nearest are met (:class:`_Boxes`). ``exclude_self`` leaves out the bank rows whose
    id has the query's quotient by ``per``, as parts of one whole have."""
    src = queries.select(F.col(id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    own = bank.select(F.col(bank_id or id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    own = own.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    apart = per if exclude_self else None
    total = own.agg(F.sum(8 * F.size("v"))).first()[0] or 0
    found = _meet_whole(src, own, k, apart) if total <= limit else _meet_blocks(src, own, k, apart, int(2 * total // limit) + 1)
    w = Window.partitionBy("i").orderBy("near", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("i").alias(id), F.col("rank").cast("int").alias("rank"), "neighbour", "distance")


_FOUND = "i long, neighbour long, distance double, near double"


def _met(q: np.ndarray, own: np.ndarray, bank: np.ndarray, ids: np.ndarray, k: int, per: int | None) -> Iterator[pd.DataFrame]:
    step = max(1, min(1024, TILE // max(1, len(ids))))
    for at in range(0, len(own) if len(ids) else 0, step):
        part = own[at : at + step]
        rows, cols, d, near = _nearest(q[at : at + step], part, bank, ids, k, per)
        yield pd.DataFrame({"i": part[rows], "neighbour": ids[cols], "distance": d, "near": near})


def _meet_whole(src: DataFrame, bank: DataFrame, k: int, per: int | None) -> DataFrame:
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"ids": [batch["i"].to_numpy(np.int64).tobytes()], "data": [np.array(batch["v"].tolist(), np.float64).tobytes()]})

    rows = bank.mapInPandas(packed, "ids binary, data binary").collect()  # within the counted limit
    ids = np.concatenate([np.frombuffer(r.ids, np.int64) for r in rows] or [np.empty(0, np.int64)])
    vectors = np.concatenate([np.frombuffer(r.data).reshape(len(r.ids) // 8, -1) for r in rows]) if rows else np.empty((0, 0))
    del rows
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    boxes = _boxes(vectors, ids, per)
    held = src.sparkSession.sparkContext.broadcast(boxes or (ids, vectors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = held.value
        for batch in batches:
            if len(batch):
                yield from _met(np.array(batch["v"].tolist(), np.float64), batch["i"].to_numpy(), vectors, ids, k, per)

    def run_boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q, n = [], [], 0
        for batch in batches:
            if len(batch):
                own.append(batch["i"].to_numpy(np.int64))
                q.append(np.array(batch["v"].tolist(), np.float64))
                n += len(batch)
            if n >= BOX_QUERIES:
                yield from held.value.met(np.concatenate(q), np.concatenate(own), k)
                own, q, n = [], [], 0
        if n:
            yield from held.value.met(np.concatenate(q), np.concatenate(own), k)

    if boxes is None:
        return src.mapInPandas(run, _FOUND)
    return src.repartition(4 * src.sparkSession.sparkContext.defaultParallelism, "i").mapInPandas(run_boxes, _FOUND)  # few bytes, much work


def _meet_blocks(src: DataFrame, bank: DataFrame, k: int, per: int | None, n: int) -> DataFrame:
    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("i")
        return pd.DataFrame({"b": [int(t["b"].iloc[0])], "ids": [t["i"].to_numpy(np.int64).tobytes()], "data": [np.array(t["v"].tolist(), np.float64).tobytes()]})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), QUERY_ROWS):
                t = batch.iloc[at : at + QUERY_ROWS]
                yield pd.DataFrame({"own": [t["i"].to_numpy(np.int64).tobytes()], "q": [np.array(t["v"].tolist(), np.float64).tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, boxes = None, None
        for batch in batches:
            for b, own, q, ids, data in zip(batch["b"], batch["own"], batch["q"], batch["ids"], batch["data"], strict=True):
                own, ids = np.frombuffer(own, np.int64), np.frombuffer(ids, np.int64)
                q, vectors = np.frombuffer(q).reshape(len(own), -1), np.frombuffer(data).reshape(len(ids), -1)
                if b != last:  # a join gives the rows of a block one after another
                    last, boxes = b, _boxes(vectors, ids, per)
                yield from boxes.met(q, own, k) if boxes else _met(q, own, vectors, ids, k, per)

    blocks = bank.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(n))).groupBy("b").applyInPandas(pack, "b long, ids binary, data binary")
    asked = src.mapInPandas(packed, "own binary, q binary").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return asked.join(blocks, "b").select("b", "own", "q", "ids", "data").mapInPandas(run, _FOUND)


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and population covariance of the vectors: one partial sum a partition, summed by position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, None, None
        for batch in batches:
            if len(batch):
                x = np.array(batch["v"].tolist(), np.float64)
                n += len(x)
                s = x.sum(0) if s is None else s + x.sum(0)
                ss = x.T @ x if ss is None else ss + x.T @ x
        if n:
            yield pd.DataFrame({"sums": [np.concatenate(([n], s, ss.ravel())).tolist()]})

    own = df.select(F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL").mapInPandas(run, "sums array<double>")
    rows = own.select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()  # 1 + d + d x d numbers
    flat = np.array([x for _, x in sorted((r.k, r.x) for r in rows)])
    d = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
    n, mean = int(flat[0]), flat[1 : d + 1] / flat[0]
    return n, mean, flat[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)


def ledoit_wolf(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance shrunk to a multiple of the identity, and the shrinkage."""
    n, mean, cov = moments(df, vector)
    d = len(mean)
    mu = np.trace(cov) / d

    @F.pandas_udf("double")
    def quartic(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), np.float64) - mean
        return pd.Series((x * x).sum(1) ** 2)

    fourth = df.agg(F.avg("q")).first()[0] if "q" in df.columns else df.select(quartic(F.col(vector)).alias("q")).agg(F.avg("q")).first()[0]
    delta = ((cov - mu * np.eye(d)) ** 2).sum() / d
    beta = (fourth - (cov**2).sum()) / (d * n)
    s = float(min(max(beta, 0.0), delta) / delta) if delta > 0 else 0.0
    return mean, (1 - s) * cov + s * mu * np.eye(d), s


def mahalanobis(df: DataFrame, vector: str, mean: np.ndarray, cov: np.ndarray, into: str = "score") -> DataFrame:
    inverse = np.linalg.pinv(cov, hermitian=True)

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), np.float64) - mean
        return pd.Series(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, inverse, x), 0)))

    return df.withColumn(into, run(F.col(vector)))


def pca_fit(df: DataFrame, vector: str, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, components (rows) and the share of variance they hold."""
    _, mean, cov = moments(df, vector)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:n]
    return mean, vectors[:, order].T, float(values[order].sum() / max(values.sum(), 1e-300))


def pca_residual(df: DataFrame, vector: str, mean: np.ndarray, components: np.ndarray, into: str = "score") -> DataFrame:
    """Mean absolute residual of the reconstruction."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), np.float64) - mean
        return pd.Series(np.abs(x - x @ components.T @ components).mean(1))

    return df.withColumn(into, run(F.col(vector)))


def random_projection(dim_in: int, dim_out: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim_in, dim_out)) / np.sqrt(dim_out)


def greedy_coreset(x: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """k-centre greedy on a bounded candidate sample: the farthest point is added, ties to the least index."""
    n = min(n, len(x))
    chosen = [first]
    least = squared_distances(x, x[first : first + 1])[:, 0]
    while len(chosen) < n:
        at = int(np.argmax(least))
        chosen.append(at)
        least = np.minimum(least, squared_distances(x, x[at : at + 1])[:, 0])
    return np.array(chosen)


def coreset(df: DataFrame, id: str, vector: str, n: int, candidates: int = 20_000, seed: int | str = 0) -> DataFrame:
    """A bank of ``n`` rows: k-centre greedy over all rows, begun at the first in seeded order, ties to the earlier in it.

    The ``candidates`` rows farthest from the bank come to the driver at a time. Distances only shrink, so picks
    among them are those of the whole while they lie farther than any row left out did."""
    from gaugeworks.operators.splits import seeded

    own = df.select(F.col(id).alias("i"), F.col(vector).cast("array<double>").alias("v"), seeded(seed, F.col(id)).alias("s")).where("v IS NOT NULL")
    ids: list = []
    bank: list[np.ndarray] = []
    while len(ids) < n:
        centres = np.array(bank)

        @F.pandas_udf("double")
        def least(v: pd.Series) -> pd.Series:
            x, d = np.array(v.tolist(), np.float64), np.full(len(v), np.inf)
            for c in centres:
                d = np.minimum(d, ((x - c) ** 2).sum(1))
            return pd.Series(d)

        far = own.where(~F.col("i").isin(ids)).withColumn("d", least("v")) if ids else own.withColumn("d", F.lit(float("inf")))
        rows = far.orderBy(F.desc("d"), "s", "i").limit(candidates + 1 if ids else 1).collect()
        if not rows:
            break
        bound = rows.pop().d if len(rows) > candidates else -1.0
        rows.sort(key=lambda r: (r.s, r.i))
        x, d = np.array([r.v for r in rows], np.float64), np.array([r.d for r in rows])
        at = int(np.argmax(d))  # the farthest of all rows, whatever the bound
        while True:
            ids.append(rows[at].i)
            bank.append(x[at])
            d = np.where(d < 0, d, np.minimum(d, ((x - x[at]) ** 2).sum(1)))
            d[at] = -1.0
            at = int(np.argmax(d))
            if len(ids) == n or d[at] <= bound or d[at] < 0:
                break
    chosen = df.sparkSession.createDataFrame([(k, o) for o, k in enumerate(ids)], f"{id} {df.schema[id].dataType.simpleString()}, pick int")
    return df.join(F.broadcast(chosen), id)  # ``n`` rows


def density_subsample(df: DataFrame, id: str, vector: str, share: float, k: int = 100, subset: int = 4_096, seed: int | str = 0) -> DataFrame:
    """(id, crowding) of the share of rows that covers the table with the fewest crowded ones.

    Rows are dealt at random to groups of about ``subset``. A row's crowding is the number of its k nearest group
    members closer than the group's mean distance to such members; a group keeps its quota of the
    least crowded, ties in random order. A task holds subset**2 distances whatever the size of the table."""
    from gaugeworks.operators.splits import ranked

    m = df.count()
    n = int(m * share)
    if not n:
        return df.select(id, F.lit(0).cast("long").alias("crowding")).limit(0)
    groups = -(-m // subset)
    own = ranked(df.select(id, vector), id, seed)
    own = own.select(F.col(id).cast("long").alias("i"), F.col(vector).alias("v"), "rank", F.pmod(F.col("rank") - 1, F.lit(groups)).cast("int").alias("g"))
    sizes = [(m - g + groups - 1) // groups for g in range(groups)]
    spare = n - sum(n * s // m for s in sizes)

    def run(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("rank")  # a random order, alike on every run
        x = np.array(table["v"].tolist(), np.float64)
        d = np.sqrt(squared_distances(x, x))
        np.fill_diagonal(d, np.inf)
        near = np.sort(d, axis=1)[:, : min(k, len(x) - 1)]
        crowd = (near < near.mean()).sum(1) if near.size else np.zeros(len(x), np.int64)
        quota = n * len(x) // m + (key[0] < spare)
        keep = np.argsort(crowd, kind="stable")[:quota]
        return pd.DataFrame({"i": table["i"].to_numpy()[keep], "crowding": crowd[keep].astype(np.int64)})

    return own.groupBy("g").applyInPandas(run, "i long, crowding long").withColumnRenamed("i", id)


def reweighted(best: DataFrame, bank: DataFrame, id: str, vector: str, patch: str, k: int = 3, per: int | None = None) -> DataFrame:
    """Scores of images from their patches' nearest bank rows.

    ``best`` has (id, patch, neighbour, distance). The farthest patch of an image gives its
    distance, weighted by 1 - softmax over the distances from the nearest bank row's own neighbours.
    With ``per`` patches an image, bank ids being id * per + patch, an image's own rows are not among these."""
    top = best.groupBy(id).agg(F.max_by(F.struct(F.col(patch).alias("patch"), "neighbour", "distance", "v"), F.struct("distance", -F.col(patch))).alias("t")).select(id, "t.*").persist()  # read twice
    member = bank.select(F.col("bank_id").alias("member"), F.col(vector).alias("m"))
    held = top.join(member, F.col("neighbour") == F.col("member")).select((F.col(id) * (per or 1)).alias("own"), F.col("m").alias(vector))
    support = knn_join(held, bank, k, "own", vector, "bank_id", exclude_self=per is not None, per=per or 1)
    support = support.select(F.floor(F.col("own") / (per or 1)).cast("long").alias(id), F.col("neighbour").alias("member"))
    near = top.join(support, id).join(member, "member")
    gap = F.sqrt(F.aggregate(F.zip_with("v", "m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return near.groupBy(id, "patch", "neighbour", "distance").agg((F.col("distance") * (1.0 - F.try_divide(F.exp(F.col("distance")), F.sum(F.exp(gap))))).alias("score"))
