"""Near-duplicate vectors by the epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of each other, and so do their
projections on leading principal directions. The vectors of a label are sorted by the grid cells
(side eps) of those projections, lexicographically, and cut into blocks: intervals of the epsilon
grid order. Blocks whose boxes are farther apart than eps are never paired; a pair is joined by
halving both intervals, skipping halves that are provably distant, down to leaves that one matrix
product compares in double precision. A block is as large as ``BLOCK_BYTES`` allows, for it travels once
to every block it may meet. How much is skipped depends on the data: where vectors of a label spread
evenly over many directions the boxes of intervals overlap, and every pair of blocks of the label is met.

A task returns link counts and, through a union-find over what it saw, only the links that
connect something new, never all pairs of a dense group. Equal vectors of a label are joined as
one, with their number. The principal directions come from a sample of ``SAMPLE`` vectors; they
decide which work is skipped, not which pairs are found.

Vectors that are null or zero or hold null or non-finite components, and rows with a null label
or id, link with nothing and form their own component (null for a null id). Rows that repeat an
id count as further vectors. Vectors of different length never link. Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.components import components
from gaugeworks.llm.store import materialise, release

THRESHOLD = 0.93
#: Leading directions, vectors they are taken from, bytes of a block, rows of a leaf.
DIRECTIONS, SAMPLE, BLOCK_BYTES, LEAF = 8, 5_000, 4 << 20, 128
_SLACK = 1e-9


def _units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(sample: np.ndarray, directions: int = DIRECTIONS) -> np.ndarray:
    """Columns: orthonormal directions of most variance of the unit vectors."""
    x = _units(sample)
    x = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(x.T @ x)
    return vectors[:, np.argsort(-values)[:directions]]


class UnionFind(dict):
    def find(self, x: int) -> int:
        path = []
        while (up := self.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self[p] = x
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def join_blocks(x: np.ndarray, y: np.ndarray | None, basis: np.ndarray, least: float, mult_x: np.ndarray, mult_y: np.ndarray, leaf: int = LEAF):
    """Link counts (weighted by the partners' numbers) of ``x`` and ``y``, and links that connect
    them; ``y`` None joins ``x`` with itself."""
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + _SLACK
    own = y is None
    y = x if own else y
    px, py = x @ basis, y @ basis
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    links: list[tuple[int, int]] = []
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if b - a > leaf or d - c > leaf:
            m, n = (a + b) // 2, (c + d) // 2
            left = [(a, m), (m, b)] if b - a > leaf else [(a, b)]
            right = [(c, n), (n, d)] if d - c > leaf else [(c, d)]
            stack += [(*p, *q) for p in left for q in right if not own or q[1] > p[0]]
            continue
        met = x[a:b] @ y[c:d].T >= least
        if own:
            if a == c and b == d:
                np.fill_diagonal(met, False)
            else:  # each unordered pair once; the overlap of unequal intervals is cut to the upper part
                met &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
        if not met.any():
            continue
        nx[a:b] += met @ mult_y[c:d]
        if own and a == c and b == d:
            pass  # symmetric: rows already hold both ways
        elif own:
            nx[c:d] += met.T @ mult_x[a:b]
        else:
            ny[c:d] += met.T @ mult_x[a:b]
        # components of the leaf by label propagation, as stars
        lx, ly = np.arange(b - a), np.arange(b - a, b - a + d - c)
        big = b - a + d - c
        while True:
            new_x = np.minimum(lx, np.where(met, ly[None, :], big).min(axis=1))
            new_y = np.minimum(ly, np.where(met, new_x[:, None], big).min(axis=0))
            if (new_x == lx).all() and (new_y == ly).all():
                break
            lx, ly = new_x, new_y
        for part, base in ((lx, 0), (ly, b - a)):
            for i in np.flatnonzero(part != np.arange(base, base + len(part))):
                t = int(part[i])
                links.append(((a + i) if base == 0 else -(c + i) - 1, (a + t) if t < b - a else -(c + t - (b - a)) - 1))
    return nx, ny, links


def near_duplicates(vectors: DataFrame, id: str = "vec_id", label: str = "label", vector: str = "embedding", threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """``id``, n_links, component_id and kept of every row; ``block``: rows of a block instead of ``BLOCK_BYTES``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("long").alias("i"), F.col(label).alias("g"), F.col(vector).alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = F.col("i").isNotNull() & F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    one = rows.where(valid).groupBy("g", "v").agg(F.min("i").alias("rep"), F.count("*").alias("mult"))
    one = materialise(one.withColumn("dim", F.size("v")), "distinct")
    size = one.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    n = size.n
    block = block or max(64, BLOCK_BYTES // (8 * (size.dim or 1)))
    sample: dict[int, list] = {}
    for r in one.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("dim", "v").collect():
        sample.setdefault(r.dim, []).append(r.v)
    found = None
    if n:
        basis = spark.sparkContext.broadcast({d: principal(np.array(v, np.float64)) for d, v in sample.items()})
        found = _join(one, n, basis, threshold, block)
    counts = found.where("other IS NULL").groupBy(F.col("rep").alias("r")).agg(F.sum("n").alias("n")) if n else None
    groups = one.select("g", "v", "rep", "mult")
    if n:
        named = components(found.where("other IS NOT NULL"), "rep", "other")
        groups = groups.join(counts, F.col("rep") == F.col("r"), "left").drop("r")
        groups = groups.join(named, F.col("rep") == F.col("id"), "left").drop("id")
    else:
        groups = groups.withColumn("n", F.lit(0)).withColumn("component", F.col("rep"))
    own = groups.select("g", "v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.where(valid).join(own, ["g", "v"]).select("i", "n", "c")
    out = out.unionAll(rows.where(~valid | valid.isNull()).select("i", F.lit(0).cast("long"), "i"))
    return out.select(F.col("i").alias(id), F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("i") == F.col("c"), F.lit(False)).alias("kept"))


def _join(one: DataFrame, n: int, basis, threshold: float, block: int) -> DataFrame:
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for v in batch.column(2).to_pylist():
                b = basis.value.get(len(v))
                x = _units(np.array([v], np.float64))
                cells.append(np.floor((x[0] @ (b if b is not None else np.eye(len(v))[:, :DIRECTIONS])) / eps).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tolist() for c in cells], pa.list_(pa.int32()))], names=[*batch.schema.names, "cell"])

    src = one.select(F.col("g").cast("string").alias("g"), "dim", F.col("v").cast("array<double>").alias("v"), "rep", "mult")
    src = src.mapInArrow(place, T.StructType([*src.schema.fields, T.StructField("cell", T.ArrayType(T.IntegerType()))]))
    keys = ["g", "dim", "cell", "rep"]
    laid = src.repartitionByRange(max(1, -(-n // (4 * block))), *keys).sortWithinPartitions(*keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, key, held = 0, None, []

        def close():
            nonlocal serial
            x = np.array([h[0] for h in held], np.float64)
            b = basis.value.get(x.shape[1])
            p = _units(x) @ (b if b is not None else np.eye(x.shape[1])[:, :DIRECTIONS])
            row = {"block": (TaskContext.get().partitionId() << 32) + serial, "g": key[0], "dim": key[1], "lo": p.min(0).tolist(), "hi": p.max(0).tolist(), "reps": np.array([h[1] for h in held], np.int64).tobytes(), "mults": np.array([h[2] for h in held], np.int64).tobytes(), "data": x.tobytes()}
            serial += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

        for batch in batches:
            for g, dim, v, rep, mult in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and ((g, dim) != key or len(held) >= block):
                    yield close()
                key = (g, dim)
                held.append((v, rep, mult))
        if held:
            yield close()

    blocks = materialise(laid.mapInArrow(cut, "block long, g string, dim int, lo array<double>, hi array<double>, reps binary, mults binary, data binary"), "blocks")
    first = lambda c: F.floor(F.get(c, F.lit(0)) / eps).cast("int")
    meta = blocks.select("block", "g", "dim", "lo", "hi", first(F.col("lo")).alias("from"), first(F.col("hi")).alias("to"))
    left = meta.select("g", "dim", *(F.col(c).alias(f"{c}_a") for c in ("block", "lo", "hi", "from")), F.explode(F.sequence("from", "to")).alias("c"))
    right = meta.select("g", "dim", *(F.col(c).alias(f"{c}_b") for c in ("block", "lo", "hi", "from")), F.explode(F.sequence(F.col("from") - 1, F.col("to") + 1)).alias("c"))
    apart = F.zip_with(F.arrays_zip("lo_a", "hi_a"), F.arrays_zip("lo_b", "hi_b"), lambda p, q: F.greatest(F.lit(0.0), p["lo_a"] - q["hi_b"], q["lo_b"] - p["hi_a"]))
    near = F.aggregate(apart, F.lit(0.0), lambda s, d: s + d * d) <= eps * eps
    once = F.col("c") == F.greatest(F.col("from_a"), F.col("from_b") - 1)
    pairs = left.join(right, ["g", "dim", "c"]).where((F.col("block_a") <= F.col("block_b")) & once & near).select("block_a", "block_b")
    data = blocks.select("block", "dim", "reps", "mults", "data")
    work = materialise(pairs, "pairs").repartition(F.col("block_a"), F.col("block_b"))
    side = lambda s: data.select(F.col("block").alias(f"block_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("dim", "reps", "mults", "data")))
    work = work.join(side("a"), "block_a").join(side("b"), "block_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = UnionFind()
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(k)[r].as_py() for k, name in enumerate(batch.schema.names)}
                side = []
                for s in "ab":
                    side.append((_units(np.frombuffer(row[f"data_{s}"]).reshape(-1, row[f"dim_{s}"])), np.frombuffer(row[f"reps_{s}"], np.int64), np.frombuffer(row[f"mults_{s}"], np.int64)))
                (x, rx, mx), (y, ry, my) = side
                b = basis.value.get(x.shape[1])
                b = b if b is not None else np.eye(x.shape[1])[:, :DIRECTIONS]
                same = row["block_a"] == row["block_b"]
                nx, ny, links = join_blocks(x, None if same else y, b, threshold, mx, mx if same else my)
                name = lambda i: int(rx[i]) if i >= 0 else int((rx if same else ry)[-i - 1])
                new = [(p, q) for p, q in ((name(i), name(j)) for i, j in links) if p != q and sets.union(p, q)]
                ids, sums = np.concatenate([rx[nx > 0], ry[ny > 0]]), np.concatenate([nx[nx > 0], ny[ny > 0]])
                yield pa.RecordBatch.from_arrays([pa.array([*ids.tolist(), *(p for p, _ in new)], pa.int64()), pa.array([*([None] * len(ids)), *(q for _, q in new)], pa.int64()), pa.array([*sums.tolist(), *([0] * len(new))], pa.int64())], ["rep", "other", "n"])
        release()

    return materialise(work.mapInArrow(compare, "rep long, other long, n long"), "found")


_BLOCKS = pa.schema([("block", pa.int64()), ("g", pa.string()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("reps", pa.binary()), ("mults", pa.binary()), ("data", pa.binary())])
