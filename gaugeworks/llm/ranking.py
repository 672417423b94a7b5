"""Ranked lexical search over inverted treaps.

The index is cut by documents: a shard holds some thousand documents in order of their ids and, for each term,
the places of the documents that hold it with the term's occurrences there. Shards are built where their texts are
read; no posting is shuffled, so a term that most documents hold is no hot key. The number of documents, their
lengths and the terms' document frequencies are summed over all shards before anything is scored.

When a shard is searched, the postings of a term become a treap: a binary search tree by place whose nodes are in
heap order by impact, so the node that covers a range of places bounds what the term adds within it. All terms
of an item descend together, best range first: a range is split at the document of its weightiest root, which is
scored, and each half takes for every term the highest node within it; a range whose summed maxima are below the
k-th best score so far is left out with its subtrees. Ranges of ``LEAF`` places are scored whole. The k best of an item
are carried from shard to shard within a task, and those of all tasks are ranked together.

Every row of the documents is a document and every row of the items is an item, also where ids repeat. Null and empty
texts have no terms: such documents are not counted, such items find nothing. Documents without an id count and are
ranked after those with one at equal score. Very long texts are read whole, empty tables give no rows, and extra
columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.store import materialise, release

#: Characters of text and postings after which a shard is closed; places of a range that is scored whole.
SHARD_CHARS, SHARD_POSTINGS, LEAF = 8 << 20, 1 << 20, 256
#: Bytes of items that are searched for together, and of their distinct terms up to which only these are indexed.
ITEM_BYTES, TERM_BYTES = 8 << 20, 8 << 20
#: A-Z to lower case, ASCII but letters and digits to spaces; what is beyond ASCII belongs to terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return text.encode().translate(_TERMS).split() if text else []


def _pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on in the fewest bytes each, after that number of bytes."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


_SHARD = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.string())), ("held", pa.list_(pa.int64())), ("places", pa.binary()), ("times", pa.binary())])
_SHARD_SQL = "ids array<long>, lengths binary, n_docs long, n_terms long, terms array<string>, held array<long>, places binary, times binary"


def index(docs: DataFrame, id: str = "doc_id", text: str = "text", only: set[bytes] | None = None, shard_chars: int = SHARD_CHARS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The written shards of ``docs``; with ``only`` they hold these terms alone (lengths still count all)."""
    wanted = docs.sparkSession.sparkContext.broadcast(only) if only is not None else None  # at most TERM_BYTES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value.__contains__ if wanted is not None else None
        numbers: dict[bytes, int] = {}
        ids, lengths, codes, times, sizes, chars = [], [], [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal chars
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            code, place, n = np.array(codes, np.int64), np.repeat(place, sizes), np.array(lengths, np.int64)
            by = np.lexsort((place, code))
            row = {"ids": [ids[k] for k in order], "lengths": _pack(n[order]), "n_docs": len(ids), "n_terms": int(n.sum()), "terms": [t.decode() for t in numbers], "held": np.bincount(code, minlength=len(numbers)).tolist(), "places": _pack(place[by]), "times": _pack(np.array(times, np.int64)[by])}
            for x in (numbers, ids, lengths, codes, times, sizes):
                x.clear()
            chars = 0
            return pa.RecordBatch.from_pylist([row], schema=_SHARD)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms(t)
                if not found:
                    continue
                own = Counter(filter(keep, found)) if keep else Counter(found)
                codes += [numbers.setdefault(w, len(numbers)) for w in own]
                times += own.values()
                sizes.append(len(own))
                ids.append(i)
                lengths.append(len(found))
                chars += len(t)
                if chars > shard_chars or len(codes) > shard_postings:
                    yield close()
        if ids:
            yield close()
        release()

    return materialise(docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(build, _SHARD_SQL), "shards")


class Treap:
    """Postings of a term: search tree by place, heap by impact."""

    __slots__ = ("adds", "at", "impact", "left", "places", "right", "root")

    def __init__(self, places: np.ndarray, impact: np.ndarray):
        self.at, self.adds = places, impact
        self.places, self.impact = places.tolist(), impact.tolist()
        n = len(self.places)
        left, right, path = [-1] * n, [-1] * n, []
        for k, v in enumerate(self.impact):
            below = -1
            while path and self.impact[path[-1]] < v:
                below = path.pop()
            left[k] = below
            if path:
                right[path[-1]] = k
            path.append(k)
        self.left, self.right, self.root = left, right, path[0] if path else -1

    def within(self, node: int, lo: int, hi: int) -> int:
        """The highest node with a place in [lo, hi) below ``node``; -1 if there is none."""
        places = self.places
        while node >= 0:
            p = places[node]
            if p >= hi:
                node = self.left[node]
            elif p < lo:
                node = self.right[node]
            else:
                break
        return node


class Best:
    """The k best (score, id): higher scores first, then smaller ids, then those without one."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @property
    def floor(self) -> int:
        """No score below this enters."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, id: int | None) -> None:
        entry = (score, -(1 << 64) if id is None else -id)
        if len(self.heap) < self.k:
            heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heappushpop(self.heap, entry)

    def rows(self) -> list[tuple[int, int | None]]:
        return [(s, None if i == -(1 << 64) else -i) for s, i in self.heap]


def search_shard(query: list[tuple[int, Treap]], ids: list[int | None], best: Best, leaf: int = LEAF) -> int:
    """Offer ``best`` every document of a shard that may enter; ``query``: weight and treap of each term. Returns how
    many documents were scored."""
    scored = 0
    roots = [t.root for _, t in query]
    frontier = [(-sum(w * t.impact[v] for (w, t), v in zip(query, roots, strict=True) if v >= 0), 0, len(ids), roots)]
    while frontier:
        bound, lo, hi, nodes = heappop(frontier)
        if -bound < best.floor:
            break
        if hi - lo <= leaf:
            total = np.zeros(hi - lo, np.int64)
            for (w, t), v in zip(query, nodes, strict=True):
                if v >= 0:
                    a, b = bisect_left(t.places, lo), bisect_left(t.places, hi)
                    total[t.at[a:b] - lo] += w * t.adds[a:b]
            scored += hi - lo
            for k in np.flatnonzero(total >= best.floor).tolist():
                best.offer(int(total[k]), ids[lo + k])
            continue
        split = max((k for k, v in enumerate(nodes) if v >= 0), key=lambda k: query[k][0] * query[k][1].impact[nodes[k]])
        d = query[split][1].places[nodes[split]]
        score = 0
        for (w, t), v in zip(query, nodes, strict=True):
            own = t.within(v, d, d + 1)
            if own >= 0:
                score += w * t.impact[own]
        scored += 1
        if score >= best.floor:
            best.offer(score, ids[d])
        for a, b in ((lo, d), (d + 1, hi)):
            if a < b:
                inside = [t.within(v, a, b) for (_, t), v in zip(query, nodes, strict=True)]
                bound = sum(w * t.impact[v] for (w, t), v in zip(query, inside, strict=True) if v >= 0)
                if bound >= best.floor:
                    heappush(frontier, (-bound, a, b, inside))
    return scored


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_terms(items: DataFrame, id: str, text: str) -> DataFrame:
    """no (of the row), item, term and its occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own := Counter(terms(t)):
                    yield pa.RecordBatch.from_arrays([pa.array([no] * len(own), pa.int64()), pa.array([w.decode() for w in own], pa.string()), pa.array(list(own.values()), pa.int64())], ["no", "term", "times"])

    return items.select("no", F.col(id).alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(count, "no long, term string, times long")


def _blocks(asked: DataFrame, limit: int) -> int:
    """Into how many blocks by hash the items are cut so that a block is within ``limit`` bytes, or one item."""
    sizes = materialise(asked.groupBy("no").agg(F.sum(F.octet_length("term") + 64).alias("b")), "sizes")
    whole = sizes.agg(F.sum("b").alias("b"), F.count("*").alias("n"), F.max("b").alias("most")).first()
    blocks = max(1, -(-(whole.b or 0) // limit))
    while blocks < (whole.n or 0):
        worst = sizes.groupBy(F.pmod(F.xxhash64("no"), F.lit(blocks))).agg(F.sum("b").alias("b")).agg(F.max("b")).first()[0]
        if worst <= max(limit, whole.most):
            break
        blocks *= 2
    return blocks


def search(docs: DataFrame, items: DataFrame, k: int = 20, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES, term_bytes: int = TERM_BYTES, leaf: int = LEAF, **shards) -> DataFrame:
    """``item``, rank, ``id`` and score of the ``k`` best documents of every item; ``shards``: sizes for ``index``."""
    spark = docs.sparkSession
    items = materialise(items.select(F.col(item).alias("_item"), F.col(item_text).cast("string").alias("t")).withColumn("no", F.monotonically_increasing_id()), "items")
    asked = materialise(_item_terms(items, "_item", "t"), "asked")
    distinct = asked.select("term").distinct()
    few = distinct.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0] <= term_bytes
    table = index(docs, id, text, {r.term.encode() for r in distinct.collect()} if few else None, **shards)
    total = table.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total.docs, total.terms
    df = table.select(F.explode(F.arrays_zip("terms", "held")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.held").alias("df"))
    asked = materialise(asked.join(df, "term"), "weighed")
    blocks, found = _blocks(asked, item_bytes), None
    for block in range(blocks):
        queries: dict[int, list[tuple[str, int]]] = {}
        for r in asked.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == block).collect():
            queries.setdefault(r.no, []).append((r.term, r.times * weight(n_docs, r.df)))
        own = _scan(table, spark.sparkContext.broadcast(queries), k, n_docs, n_terms, leaf)
        found = own if found is None else found.unionAll(own)
    last = Window.partitionBy("no").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.join(items.select("no", "_item"), "no").select(F.col("_item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id), "score")


def _scan(table: DataFrame, queries, k: int, n_docs: int, n_terms: int, leaf: int) -> DataFrame:
    """The ``k`` best of every item among the shards of each task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {no: Best(k) for no in queries.value}
        sought = {t for own in queries.value.values() for t, _ in own}
        for batch in batches:
            for r in range(batch.num_rows):
                ids, lengths, names, held, places, times = (batch.column(c)[r].as_py() for c in range(6))
                treaps = _open(_unpack(lengths), names, held, _unpack(places), _unpack(times), sought, n_docs, n_terms)
                for no, own in queries.value.items():
                    query = [(w, treaps[t]) for t, w in own if w and t in treaps]
                    if query:
                        search_shard(query, ids, best[no], leaf)
        rows = [(no, i, s) for no, b in best.items() for s, i in b.rows()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["no", "doc", "score"])
        release()

    return table.select("ids", "lengths", "terms", "held", "places", "times").mapInArrow(scan, "no long, doc long, score long")


def _open(lengths: np.ndarray, names: Iterable[str], held: list[int], places: np.ndarray, times: np.ndarray, sought: set[str], n_docs: int, n_terms: int) -> dict[str, Treap]:
    """Treaps of the sought terms of a shard."""
    norm = 75 + (25 * lengths * n_docs) // n_terms
    out, at = {}, 0
    for t, n in zip(names, held, strict=True):
        if t in sought:
            p, tf = places[at : at + n], times[at : at + n]
            out[t] = Treap(p, (1_000_000_000 * tf) // (1000 * tf + 12 * norm[p]))
        at += n
    return out
