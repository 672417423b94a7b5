"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Features are the lower-cased words of a text and, as stems, their first four bytes, hashed into 2**20 places,
so a model has a bounded size whatever the vocabulary. Every word of the examples counts but stop words
(in more than ``MOST_TEXTS`` of all texts and of both labels alike): its weight is (1 + ln tf) times its inverse document frequency over all
texts times how far its presence depends on the label among the examples (between ``FLOOR`` and 1, by the
chi-square and the ratio of the classes' frequencies). Without that last factor the nearest texts are those
of one topic and language, toxic or not.

The examples are unit vectors in an inverted index: for each feature its postings by block of examples, with the
highest weight in each block. A query adds the block maxima, visits blocks by descending bound,
and stops when no bound can reach the k-th best similarity, so its neighbours are exact. Votes weighted by
the cube of the similarity, with the base rate as ``PRIOR`` pseudo-votes, give the score; all voting
neighbours are the evidence.

Equal example vectors are held once, with their votes, so copies cost nothing. The examples are
the ``EXAMPLES`` labelled training rows that come first by a hash of their id (a documented bound
on what is fitted); document frequencies and scores cover all rows. Null and empty texts, and
texts that share no word with an example, get the base rate; texts are read whole; repeated documents are
scored alike; equally near examples count in a fixed order; conflicting labels of one id count as toxic;
a null id is never a training row, and counts as held out; empty tables give no rows; extra columns pass
through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.jaccard import word_hashes
from gaugeworks.llm.store import release, unused

#: Labelled training rows that are fitted, and neighbours that vote.
EXAMPLES, NEIGHBOURS = 8_192, 15
#: Bits of a feature's place; bytes of a longer word that stand for its stem.
BITS, STEM = 20, 4
#: Least weight of a word that says nothing about the label; chi-square and ratio at which one says much.
FLOOR, CHI2, RATIO = 0.01, 30.0, 4.0
#: Share of all texts beyond which a word is a stop word, unless it depends on the label for more than ``TELLING``.
MOST_TEXTS, TELLING = 0.05, 0.5
#: Pseudo-votes; power of the similarity in a vote.
PRIOR, POWER = 0.5, 3
#: Examples in a block; postings up to which a query adds them up without bounds; blocks visited first.
BLOCK, SHORT, VISITED = 64, 65_536, 16
_OTHER = re.compile(r"[\W\d_]+")
_LETTERS = bytes(b if chr(b).isalpha() and b < 0x80 else 0x20 for b in range(256)).decode("latin-1")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The places of the distinct words and stems of ``text``, ascending, and how often each occurs."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = text.lower()
    both = word_hashes(low.translate(_LETTERS) if low.isascii() else _OTHER.sub(" ", low), stem=STEM)
    return np.unique((np.concatenate(both) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[k], ..., first[k] + size[k] - 1 of all k in a row."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


@dataclass
class Model:
    """Weights by place, the base rate, and the examples by segment: the postings of one feature in one block."""

    weight: np.ndarray
    base: float
    k: int = NEIGHBOURS

    def __post_init__(self):
        self.add([])

    def vector(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts
        w = (1 + np.log(n)) * self.weight[at]
        kept = w > 0
        at, w = at[kept], w[kept]
        norm = math.sqrt(float(w @ w))
        return at, w / norm if norm else w

    def add(self, examples: Iterable[tuple[int, int, tuple[np.ndarray, np.ndarray]]]) -> Model:
        """``examples``: id, label, vector. Equal vectors are merged; similar ones become neighbours in blocks."""
        merged: dict[bytes, list] = {}
        for i, y, (at, w) in sorted(examples, key=lambda e: e[0]):
            if len(at):
                name = hashlib.blake2b(at.astype(np.int32).tobytes() + np.round(w, 9).tobytes(), digest_size=32).digest()
                slot = merged.setdefault(name, [at, w, [0, 0], i])
                slot[2][y] += 1
        rows = sorted(merged.values(), key=lambda r: [*r[0][np.lexsort((r[0], -r[1]))[:4]].tolist(), r[3]])
        self.votes = np.array([r[2] for r in rows], float).reshape(-1, 2)
        self.evidence = [r[3] for r in rows]
        del merged
        at = np.concatenate([np.zeros(0, np.int64), *(r[0] for r in rows)])
        of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        order = np.lexsort((of, at))
        self.example = of[order].astype(np.int32)
        self.value = np.concatenate([np.zeros(0), *(r[1] for r in rows)])[order]
        del rows, of
        key = at[order] << 32 | self.example // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.segment_first, self.segment_size = first, np.diff(first, append=len(key))
        self.segment_block = (key[first] & 0xFFFFFFFF).astype(np.int32)
        self.segment_max = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0)
        self.places, start = np.unique(key[first] >> 32, return_index=True)
        self.segments = np.append(start, len(first))  # of each place
        self.first = np.append(first, len(key))[self.segments]  # postings of each place, in a row
        return self

    def neighbours(self, query: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest distinct examples with positive similarity and those similarities, ties by position: exact."""
        at, x = query
        where = np.searchsorted(self.places, at)
        met = np.flatnonzero(self.places[np.minimum(where, len(self.places) - 1)] == at) if len(self.places) else where[:0]
        where, x = where[met], x[met]
        whole = self.first[where + 1] - self.first[where]
        n = len(self.votes)
        if int(whole.sum()) <= SHORT:  # nothing to skip
            return self._best(_runs(self.first[where], whole), np.repeat(x, whole), np.zeros(0, np.int64), np.zeros(0))
        first = self.segments[where]
        size = self.segments[where + 1] - first
        segment, x = _runs(first, size), np.repeat(x, size)
        block = self.segment_block[segment]
        bound = np.bincount(block, x * self.segment_max[segment], n // BLOCK + 1)
        order = np.argsort(-bound, kind="stable")
        best, score = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, VISITED
        while done < len(order) and bound[order[done]] > 0 and not (len(best) >= self.k and bound[order[done]] < score[-1] - 1e-12):
            chosen = np.zeros(len(bound), bool)
            chosen[order[done : done + step]] = True
            inside = np.flatnonzero(chosen[block])
            done, step = done + step, 2 * step
            size = self.segment_size[segment[inside]]
            best, score = self._best(_runs(self.segment_first[segment[inside]], size), np.repeat(x[inside], size), best, score)
        return best, score

    def _best(self, posting: np.ndarray, x: np.ndarray, best: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``best`` and its ``score`` with the examples that the postings add up to."""
        sums = np.bincount(self.example[posting], x * self.value[posting], len(self.votes))
        found = np.flatnonzero(sums > 0)
        if len(found) > 4 * self.k:  # ties with the k-th stay
            found = found[sums[found] >= np.partition(sums[found], -self.k)[-self.k]]
        best, score = np.concatenate((best, found)), np.concatenate((score, sums[found]))
        top = np.lexsort((best, -score))[: self.k]
        return best[top], score[top]

    def score(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[float, list[int]]:
        """Calibrated score, and the ids of the voting examples, nearest first."""
        met, near = self.neighbours(self.vector(counts))
        if not len(met):
            return self.base, []
        # a merged example stands for its copies but with a damped say, so that one text's copies do not decide alone
        votes = self.votes[met]
        copies = votes.sum(axis=1)
        weight = near**POWER * np.log2(1 + copies)
        value = float((weight @ (votes[:, 1] / copies) + PRIOR * self.base) / (weight.sum() + PRIOR))
        return min(max(value, 0.0), 1.0), [self.evidence[i] for i in met.tolist()]


def held_out(id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(True))


def dependence(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """From ``FLOOR`` to 1: how far a word's presence, in so many toxic and clean texts, depends on the label."""
    a, b, c, d = toxic, clean, n_toxic - toxic, n_clean - clean
    below = (a + b) * (c + d) * (a + c) * (b + d)
    chi2 = (n_toxic + n_clean) * (a * d - b * c) ** 2 / np.where(below > 0, below, 1)
    # smoothed by half a text: a word of long texts is in both classes and would only make neighbours of equals
    ratio = np.abs(np.log((a + 0.5) / (n_toxic + 1) * ((n_clean + 1) / (b + 0.5))))
    sure = np.where(below > 0, chi2**2 / (chi2**2 + CHI2**2), 0) * np.minimum(1, ratio / math.log(RATIO)) ** 2
    return FLOOR + (1 - FLOOR) * sure


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES) -> Model:
    known = labels.select(F.col(id).alias("i"), F.col(label).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("i")))
    chosen = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(examples)
    # at most ``examples`` rows of two numbers
    taken = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "i")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([f[k].astype(np.int32).tobytes() for f in own], pa.binary()) for k in (0, 1))], ["i", "y", "f", "n"])

    kind = taken.schema["i"].dataType.simpleString()
    rows = taken.mapInArrow(places, f"i {kind}, y int, f binary, n binary").toArrow()  # ``examples`` rows of 2**BITS places at most
    model = Model(np.zeros(1 << BITS), 0.0)
    if not rows.num_rows:
        return model
    counts = lambda c: [np.frombuffer(x.as_buffer(), np.int32) for chunk in rows.column(c).chunks for x in chunk]  # noqa: E731  no copies
    own = list(zip(rows.column("i").to_pylist(), [1 if y == 1 else 0 for y in rows.column("y").to_pylist()], zip(counts("f"), counts("n"), strict=True), strict=True))
    present = [np.bincount(np.concatenate([np.zeros(0, np.int32), *(c[0] for _, y, c in own if y == label)]), minlength=1 << BITS) for label in (1, 0)]
    n_toxic = float(sum(y for _, y, _ in own))
    n_clean = len(own) - n_toxic
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(present[0] + present[1] > 0))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, met, n = np.unpackbits(held.value).astype(bool), np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                met[features(t)[0]] += 1
        at = np.flatnonzero(wanted & (met > 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(met[at], n), pa.int64())], ["f", "n"])
        release()

    counted = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(frequency, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()  # 2**BITS rows at most
    held.unpersist()
    at, n = (counted.column(k).to_numpy() for k in ("f", "n"))
    total = int(n[at < 0].sum())
    at, n = at[at >= 0], n[at >= 0]
    idf = np.log((1 + total) / (1 + n)) + 1
    depends = dependence(present[0][at].astype(float), present[1][at].astype(float), n_toxic, n_clean)
    model.weight[at] = np.where((n > max(1.0, MOST_TEXTS * total)) & (depends <= TELLING), 0.0, idf * depends)
    bare = [y for _, y, c in own if not len(c[0])]
    model.base = (sum(bare) + n_toxic / len(own)) / (len(bare) + 1)
    model.add((i, y, model.vector(c)) for i, y, c in own)
    del own, rows, present, counted
    release()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "_toxicity") -> DataFrame:
    """``docs`` with ``into``: struct<score double, evidence array<long>>; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by its examples and 2**BITS places
    src = docs.drop(into)
    at = src.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            rows = [m.score(features(t)) for t in batch.column(at).cast(pa.string()).to_pylist()]
            own = pa.StructArray.from_arrays([pa.array([s for s, _ in rows], pa.float64()), pa.array([e for _, e in rows], pa.list_(pa.int64()))], ["score", "evidence"])
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, into])
        release()

    result = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))])
    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(into, result)]))


def reject(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score below ``least``, all columns kept."""
    into = unused("toxicity", docs)
    return score(docs, model, text, into).where(F.col(f"{into}.score") < least).drop(into)
