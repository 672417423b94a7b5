"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters. Every
window of 13 item words (all words of a shorter item) is hashed; executors scan the windows of
the training documents with a rolling sum, look the hashes up and verify each hit word by word.

The test items are broadcast while their texts and ids, repeated ones counted once, are under
``ITEM_BYTES``: a text of n bytes has at most (n + 1) / 2 words, and a window costs 24 bytes, so the
windows of a broadcast stay under about 100 MB whatever the items hold. More items are taken in blocks
of that size, each against all documents, and the hits are joined by row. A document is judged
(:func:`contamination`), dropped (:func:`remove_contaminated`) or mended (:func:`remove_spans`).

Null and empty texts have no words; an item without words matches nothing; the windows of an item without an id
hit, but nothing is named or counted for it; items of one text share its
windows and are all named, an id once however often it repeats; repeated documents are judged one by
one; documents are scanned whole; extra columns are carried along, whatever their names; empty tables
give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.store import materialise, release, unused

WINDOW = 13
#: Bytes of item texts and ids held in one broadcast; the rest follows in further blocks.
ITEM_BYTES = 8 << 20
_SPACE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_FACTOR = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_SPACE).split() if text else []


def _sums(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of ``length`` ids."""
    n = len(ids) - length + 1
    out = np.zeros(n, np.uint64)
    f = np.uint64(_FACTOR)
    for k in range(length):
        out *= f
        out += ids[k : n + k]
    return out ^ (out >> np.uint64(29))


class NGrams:
    """The windows of test items: by length the sorted hashes and, alike, where each window begins and its text's number."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        texts: dict[str, int] = {}
        self.names: list[list[str]] = []  # the items of each distinct text
        self.flat = np.zeros(0, np.uint32)
        rows: list[np.ndarray] = []
        sizes: dict[int, list[tuple[int, int]]] = {}  # window length -> (text, where its words begin)
        total = 0
        for name, text in items:
            named = [] if name is None else [str(name)]
            if text in texts:
                self.names[texts[text]] += named
                continue
            own = words(text)
            if not own:
                continue
            texts[text] = len(self.names)
            self.names.append(named)
            rows.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own], np.uint32))
            sizes.setdefault(min(window, len(own)), []).append((len(rows) - 1, total))
            total += len(own)
        if rows:
            self.flat = np.concatenate(rows)
        self.by_size = {}
        for size, own in sizes.items():
            hashes = np.concatenate([_sums(rows[k].astype(np.uint64), size) for k, _ in own])
            starts = np.concatenate([np.arange(at, at + len(rows[k]) - size + 1) for k, at in own])
            owner = np.repeat(np.array([k for k, _ in own], np.int32), [len(rows[k]) - size + 1 for k, _ in own])
            order = np.argsort(hashes, kind="stable")
            self.by_size[size] = (hashes[order], starts[order], owner[order])

    def scan(self, own: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which of the words ``own`` lie inside an occurrence of a window, and the items met."""
        hit, met = np.zeros(len(own), bool), set()
        if not own:
            return hit, met
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in own), np.uint64, len(own))
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for size, (hashes, starts, owner) in self.by_size.items():
            if len(own) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            sums = _sums(ids, size)[at]
            low = np.searchsorted(hashes, sums)
            high = np.searchsorted(hashes, sums, "right")
            for a, lo, hi in zip(at[low < high], low[low < high], high[low < high], strict=True):
                same = (self.flat[starts[lo:hi, None] + np.arange(size)] == ids[a : a + size]).all(axis=1)
                if same.any():
                    hit[a : a + size] = True
                    met.update(owner[lo:hi][same].tolist())
        return hit, met


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list]:
    """The distinct items in blocks of bounded size; one block unless the checked size exceeds the bound."""
    own = items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull()).distinct()
    total = own.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length(F.col("i").cast("string")), F.lit(0)))).first()[0] or 0
    n = int(2 * total // block_bytes) + 1 if total > block_bytes else 1
    for k in range(n):
        # items of one text may lie in different blocks: each holds the text, and the names of its own
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def _scan(docs: DataFrame, grams: NGrams, text: str, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with number of words, places of the hit words and sorted item ids of every row."""
    held = docs.sparkSession.sparkContext.broadcast(grams)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = held.value
        for batch in batches:
            size, places, met_items = [], [], []
            for t in batch.column(at).cast(pa.string()).to_pylist():
                own = words(t)
                hit, met = ngrams.scan(own)
                size.append(len(own))
                places.append(np.flatnonzero(hit))
                met_items.append(sorted({n for i in met for n in ngrams.names[i]}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(met_items, pa.list_(pa.string()))], names=[*batch.schema.names, *names])
        release()

    kinds = (T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType()))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))]))


def located(docs: DataFrame, items: DataFrame, names: tuple[str, str, str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """``docs`` with three columns called ``names``: words, places of hit words and item ids; no shuffle in the usual case of one block."""
    blocks = _blocks(items, item_id, item_text, block_bytes)
    first, rest = next(blocks), next(blocks, None)
    if rest is None:
        return _scan(docs, NGrams(first, window), text, names)
    # more items than one broadcast holds: the hits of each block meet by row
    n, places, met = names
    row = unused("row", docs)
    keyed = materialise(docs.withColumn(row, F.expr("uuid()")), "rows")
    found = None
    for block in (first, rest, *blocks):
        part = _scan(keyed.select(row, text), NGrams(block, window), text, names).drop(text)
        part = part.where(F.size(places) > 0)
        found = part if found is None else found.unionByName(part)
    join = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    hits = found.groupBy(row).agg(join(places), join(met))
    count = F.size(F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), "")).cast("long")
    out = keyed.withColumn(n, count).join(hits, row, "left")
    return out.select(*docs.columns, n, *(F.coalesce(c, F.array().cast(f"array<{k}>")).alias(c) for c, k in ((places, "bigint"), (met, "string"))))


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``id`` of every document with _n_words, _n_hit and _items (sorted ids as strings)."""
    src = docs.select(F.col(id).alias("i"), F.col(text).alias("t"))
    out = located(src, items, ("n", "places", "met"), "t", **options)
    return out.select(F.col("i").alias(id), F.col("n").alias("_n_words"), F.size("places").cast("long").alias("_n_hit"), F.col("met").alias("_items"))


def is_contaminated(n_words: F.Column | str = "_n_words", n_hit: F.Column | str = "_n_hit") -> F.Column:
    """At least one hit word, and one word in twenty or more hit."""
    n, hit = (F.col(c) if isinstance(c, str) else c for c in (n_words, n_hit))
    return (hit > 0) & (20 * hit >= n)


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without the contaminated ones, all columns kept."""
    names = tuple(unused(n, docs) for n in ("words", "places", "met"))
    judged = located(docs, items, names, text, **options)
    return judged.where(~is_contaminated(names[0], F.size(names[1]))).select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Every document with the hit words cut from its text, what lies between them included; texts
    without hits stay as they are. The words before and after a cut keep their own separators."""
    names = tuple(unused(n, docs) for n in ("words", "places", "met"))
    found = located(docs, items, names, text, **options)
    at, where = found.columns.index(text), found.columns.index(names[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without(t, hit) for t, hit in zip(batch.column(at).to_pylist(), batch.column(where).to_pylist(), strict=True)]
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return found.mapInArrow(run, found.schema).select(*docs.columns)


def without(text: str | None, places: list[int]) -> str | None:
    """``text`` without the words at ``places`` (ascending) and what lies between neighbouring ones."""
    if not text or not places:
        return text
    raw = text.encode()
    flat = raw.lower().translate(_SPACE)
    bad, out, at, copied, last = set(places), bytearray(), 0, 0, False
    for n, word in enumerate(flat.split()):
        start = flat.index(word, at)
        at = start + len(word)
        if n in bad:
            if not last:
                out += raw[copied:start]
            copied = at
        last = n in bad
    return (bytes(out) + raw[copied:]).decode()


def items_digest(names: F.Column) -> F.Column:
    return F.sha2(F.array_join(names, ","), 256)
