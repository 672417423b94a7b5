"""Jaccard join of word shingles by PartEnum signatures.

A document is the set of its distinct five-word shingles. Two sets A and B with Jaccard >= 3/4
differ in at most (|A| + |B|) / 7 elements. Sets are put in bands of size; the band of the
smaller set fixes the greatest difference k, and the feature domain is partitioned into
n = k + 1 + h parts. At most k parts can differ, so h + 1 or more agree: each set enumerates its
parts and gives one signature for each, a digest of its elements there. A set whose larger
partner's band is its own or one that a smaller partner may lie in gives the signatures of both.
A part without elements says nothing and is common to very many sets; the first h empty parts of a set
are left out, and what they leave of h serves to leave out the signatures that most sets share. The
order is the same for all sets, so of any h + 1 agreeing parts both still keep the same one, and no
pair is lost.

Signatures travel packed by bucket and meet in one group per bucket. Groups of up to ``GROUP`` sets
give all their pairs; a larger one gives a star around a centre chosen by hash. Candidate pairs
pass a size check and an exact bound from parity sketches (bits that differ <= |A xor B|); the
rest are verified on the whole sets, a spanning forest first, then those pairs that still lie in
different components. Then the members of larger groups are looked at again: those of the group's
greatest component are settled, the others meet them and one another in chunks of bounded size,
and a chunk gives a spanning forest of verified links, so no group is ever expanded to its pairs.

Equal sets are joined as one, by two independent 64-bit digests (128 bits: for 10**10 texts a chance
of about 10**-19 that two different ones are taken for one). Null and empty texts have no shingles and
link with nothing; fewer than five words form one shingle; repeated rows share a component; rows that
repeat an id with different texts are judged row by row; a null id has a null component; texts are read
whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.components import components
from gaugeworks.llm.store import materialise, release, small_or_shuffled

SHINGLE = 5
#: Sets of a signature group that are paired directly, sets and elements of a chunk of a larger group, least 64-bit words of a sketch.
GROUP, CHUNK, CHUNK_ELEMENTS, SKETCH = 16, 2_048, 4 << 20, 4
#: Positions an element of the sketches that tell the members of a family apart; sets of a chunk compared at once.
WIDE, STRIP = 8, 64
#: Signatures that a task holds before it hands them on.
HELD = 1_000_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


#: Places in a word whose byte values are tabulated; further ones are computed.
PLACES = 64


def _value(byte: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """A random 64-bit value for each (byte, place in its word)."""
    return _mix((byte.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


#: Two independent functions: the first names shingles, the second confirms that sets with one digest are equal.
_SALTS = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_TABLES = [_value(np.tile(_LOWER, PLACES), np.repeat(np.arange(PLACES), 256), salt) * ~np.tile(_SPACE, PLACES) for salt in _SALTS]
#: Bytes that are hashed at once; longer texts are cut between words.
PIECE = 1 << 20


def word_hashes(text: str, functions: int = 1, stem: int = 0) -> list[np.ndarray]:
    """64-bit hashes of the words of ``text`` in order, one array for each hash function: the sum of a
    word's tabulated values for byte and place, mixed with its length. With ``stem`` a further array has those of the
    first so many bytes of each longer word."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out: list[list[np.ndarray]] = [[] for _ in range(functions + bool(stem))]
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and not _SPACE[raw[end]]:
            more = np.flatnonzero(_SPACE[raw[end : end + PIECE]])
            end = end + int(more[0]) if len(more) else min(len(raw), end + PIECE)
        part = raw[at:end]
        at = end
        gap = np.concatenate(([True], _SPACE[part], [True]))
        start = np.flatnonzero(gap[:-1] & ~gap[1:])
        stop = np.flatnonzero(~gap[:-1] & gap[1:])
        if not len(start):
            continue
        part = part[start[0] :]
        start, stop = start - start[0], stop - start[0]
        place = np.arange(len(part)) - np.repeat(start, np.diff(start, append=len(part)))
        far = np.flatnonzero((place >= PLACES) & ~_SPACE[part])
        cell = np.minimum(place, PLACES - 1) << 8 | part
        for k in range(functions):
            values = _TABLES[k][cell]
            if len(far):
                values[far] = _value(_LOWER[part[far]], place[far], _SALTS[k])
            values[_SPACE[part]] = 0
            out[k].append(_mix(np.add.reduceat(values, start) + (stop - start).astype(np.uint64)))
            if stem and not k:
                longer = start[stop - start > stem]
                head = values[longer]
                for place in range(1, stem):
                    head = head + values[longer + place]
                out[-1].append(_mix(head))
    return [np.concatenate(o) if o else np.zeros(0, np.uint64) for o in out]


def _combined(own: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words, or of the whole sequence where there are fewer."""
    size = min(SHINGLE, len(own))
    n = len(own) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mix(out * _M1 + own[k : n + k])
    return out


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of the distinct shingles of ``text``."""
    (own,) = word_hashes(text) if text else (np.zeros(0, np.uint64),)
    if not len(own):
        return own
    out = np.sort(_combined(own))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def confirmed(text: str | None) -> tuple[np.ndarray, int]:
    """The shingles of ``text`` and a digest of the set under the second hash function."""
    own, more = word_hashes(text, 2) if text else (np.zeros(0, np.uint64),) * 2
    if not len(own):
        return own, 0
    out, second = _combined(own), _combined(more)
    order = np.argsort(out, kind="stable")
    out = out[order]
    fresh = np.concatenate(([True], out[1:] != out[:-1]))
    return out[fresh], int(np.sum(_mix(second[order[fresh]]), dtype=np.uint64).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard of at least 3/4, by whole numbers."""
    if not len(a) or not len(b) or 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def band_of(size: int) -> int:
    b = 0
    while BANDS[b][1] < size:
        b += 1
    return b


def _bands() -> list[tuple[int, int, int, int]]:
    """(least size, greatest size, parts, empty parts that may be left out) of each band."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, int(low * 1.6))
        k = (high + 4 * high // 3) // 7
        h = 1 + -(-(k + 1) * 30 // 100)
        out.append((low, high, k + 1 + h, h))
        low = high + 1
    return out


BANDS = _bands()


def _parts(own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each band of a set: its number, the parts that hold elements and where they begin. The
    parts are equal ranges of the hash space, so a sorted set lies in them in order."""
    top = band_of(len(own))
    for band in range(top, -1, -1):
        _, high, n, _ = BANDS[band]
        if band < top and 4 * high // 3 < len(own):
            return  # no smaller partner lies there
        parts = ((own >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1])))
        yield band, parts[first], first


def signatures(own: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a set: 64-bit digests of (band, part, elements), the lowest bit that of the band."""
    if not len(own):
        return np.zeros(0, np.uint64)
    out = []
    value = _mix(own ^ np.uint64(0x9E3779B97F4A7C15))
    for band, at, first in _parts(own):
        _, _, n, spare = BANDS[band]
        sums = np.add.reduceat(value, first)
        if n - len(at) > spare:
            empty = np.setdiff1d(np.arange(n, dtype=np.uint64), at)[spare:]
            sums, at = np.concatenate((sums, np.zeros(len(empty), np.uint64))), np.concatenate((at, empty))
        salt = np.uint64((band * 0x2545F4914F6CDD1D + 1) & (1 << 64) - 1)
        out.append(_mix(sums ^ _mix(at * np.uint64(1_000_003) + salt)) & np.uint64((1 << 64) - 2) | np.uint64(band & 1))
    return np.concatenate(out)


def _spare(own: np.ndarray) -> list[int]:
    """What the empty parts leave of the number of signatures that may be left out, for even and odd bands."""
    left = [0, 0]
    for band, at, _ in _parts(own):
        _, _, n, spare = BANDS[band]
        left[band & 1] = max(0, spare - (n - len(at)))
    return left


def _digest(own: np.ndarray) -> int:
    import xxhash

    d = xxhash.xxh3_64_intdigest(own.tobytes())
    return d - (1 << 64) if d >> 63 else d


def _sketch(own: np.ndarray, positions: int = 2) -> bytes:
    """Parities of the elements by position, with ``positions`` to twice as many an element: the bits in
    which two sketches differ are at most the elements in which the sets do."""
    bits = max(64 * SKETCH, 1 << (positions * len(own) - 1).bit_length())
    odd = np.bincount((_mix(own ^ _M2) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _fold(sketch: bytes, size: int) -> np.ndarray:
    """A sketch of ``size`` bytes as 64-bit words: a longer one is halved by exclusive or."""
    own = np.frombuffer(sketch, np.uint64)
    while len(own) * 8 > size:
        own = own[: len(own) // 2] ^ own[len(own) // 2 :]
    return own


def describe(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, h, g, sketch, spare): size, two digests, parity sketch and spare signatures of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [confirmed(t) for t in batch.column(1).to_pylist()]
            sets = [own for own, _ in both]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.int64()),
                    pa.array([g for _, g in both], pa.int64()),
                    pa.array([_sketch(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([_spare(s) if len(s) else None for s in sets], pa.list_(pa.int32())),
                ],
                ["id", "n", "h", "g", "sketch", "spare"],
            )
        release()

    src = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    return src.mapInArrow(run, "id long, n long, h long, g long, sketch binary, spare array<int>")


def _packed(docs: DataFrame, bits: int, text: str) -> DataFrame:
    """(bucket, data): signatures of the distinct sets, those of a bucket packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        ids: list[int] = []
        counts: list[int] = []
        held = 0

        def flush():
            flat, own = np.concatenate(sigs), np.repeat(np.array(ids, np.int64), counts)
            order = np.argsort(flat)
            flat, own = flat[order], own[order]
            bucket = (flat >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(flat)]))
            low = flat.astype(np.uint32)
            rows = [(int(bucket[a]), low[a:b].tobytes() + own[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            sigs.clear(), ids.clear(), counts.clear()
            for at in range(0, len(rows), 1024):
                part = rows[at : at + 1024]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], ["bucket", "data"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                own = shingles(t)
                if not len(own):
                    continue
                h = _digest(own)
                if h in seen:
                    continue
                seen.add(h)
                s = signatures(own)
                sigs.append(s)
                ids.append(h)
                counts.append(len(s))
                held += len(s)
            if held > HELD:
                yield from flush()
                held = 0
            if len(seen) > 200_000:
                seen.clear()
        if held:
            yield from flush()
        release()

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "bucket int, data binary")


def _meet(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one bucket: pairs (a, b) with group null, and members a of larger groups with the group's size."""
    low, own = [], []
    for data in table["data"]:
        n = len(data) // 12
        low.append(np.frombuffer(data, np.uint32, n))
        own.append(np.frombuffer(data, np.int64, n, 4 * n))
    sig, ids = np.concatenate(low), np.concatenate(own)
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])))
    sig, ids = sig[fresh], ids[fresh]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.concatenate((first, [len(sig)])))
    left, right, group, member, sizes = [], [], [], [], []
    for m in range(2, GROUP + 1):
        at = first[size == m]
        if len(at):
            i, j = np.triu_indices(m, 1)
            left.append(ids[at[:, None] + i].ravel())
            right.append(ids[at[:, None] + j].ravel())
    for f, m in zip(first[size > GROUP], size[size > GROUP], strict=True):
        own = ids[f : f + m]
        centre = own[np.argmin(_mix(own.view(np.uint64) ^ np.uint64(sig[f])))]
        rest = own[own != centre]
        left.append(np.minimum(rest, centre))
        right.append(np.maximum(rest, centre))
        group.append(np.full(m, int(key[0]) << 32 | int(sig[f]), np.int64))
        member.append(own)
        sizes.append(np.full(m, m, np.int64))
    pairs = np.unique(np.stack((np.concatenate(left), np.concatenate(right)), 1), axis=0) if left else np.zeros((0, 2), np.int64)
    out = pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]}).astype("Int64")
    out["grp"] = pd.array([None] * len(out), "Int64")
    out["size"] = out["grp"]
    if group:
        more = pd.DataFrame({"a": np.concatenate(member), "grp": np.concatenate(group), "size": np.concatenate(sizes)}).astype("Int64")
        more["b"] = pd.array([None] * len(more), "Int64")
        out = pd.concat([out, more[["a", "b", "grp", "size"]]])
    return out


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) of which two sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (2, 3))
            good = pa.array([similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)
        release()

    side = lambda s: sets.select(F.col("id").alias(s), F.col("data").alias(f"data_{s}"))
    work = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "data_a", "data_b")
    return materialise(work.mapInArrow(run, "a long, b long"), "links")


def _possible(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose sizes and sketches do not rule out similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (batch.column(k).to_pylist() for k in range(6))
            good = [7 * int(np.bitwise_count(_fold(p, min(len(p), len(q))) ^ _fold(q, min(len(p), len(q)))).sum()) <= i + j for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([min(i, j) for i, j in zip(a, b, strict=True)], pa.int64()), pa.array([max(i, j) for i, j in zip(a, b, strict=True)], pa.int64())], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    n, m = F.col("n_a"), F.col("n_b")
    own = pairs.where(4 * F.least(n, m) >= 3 * F.greatest(n, m)).select("r_a", "r_b", "n_a", "n_b", "s_a", "s_b")
    return own.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, n_shingles and component_id of every row."""
    own = materialise(describe(docs, id, text), "sets")
    # one entry for equal sets, named by the least id
    reps = own.where("n > 0 AND id IS NOT NULL").groupBy("h", "g").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "sketch", "spare")))
    reps = materialise(reps, "reps")
    links = _links(docs, own, reps, id, text)
    named = reps.select("h", "g", "rep").join(components(links).withColumnRenamed("id", "rep"), "rep", "left").select("h", "g", F.coalesce("component", "rep").alias("c"))
    # texts without shingles have a null in their key, so they meet nobody, and spread over the tasks by the rest of it
    out = own.select("id", "n", F.when(F.col("n") > 0, F.col("h")).alias("h"), F.when(F.col("n") > 0, F.col("g")).otherwise(F.xxhash64("id")).alias("g")).join(small_or_shuffled(named, 24), ["h", "g"], "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"))


def _links(docs: DataFrame, own: DataFrame, reps: DataFrame, id: str, text: str) -> DataFrame:
    """Verified links (a, b) between entries of ``reps`` that connect what similarity connects."""
    bits = max(8, int(own.count() // 2_000).bit_length())
    met = _packed(docs, bits, text).groupBy("bucket").applyInPandas(_meet, "a long, b long, grp long, size long")
    met = materialise(met, "candidates")
    side = lambda s: reps.select(F.col("h").alias(s), F.col("rep").alias(f"r_{s}"), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))
    pairs = met.where("grp IS NULL").select("a", "b").distinct()
    pairs = _possible(pairs.join(side("a"), "a").join(side("b"), "b"))
    pairs = materialise(pairs, "possible")
    forest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    sets = _sets(docs, pairs.select("a").unionAll(pairs.select("b")).distinct(), id, text)
    links = _verified(forest, sets)
    named = components(links)
    to = lambda s: named.select(F.col("id").alias(s), F.col("component").alias(f"c_{s}"))
    apart = pairs.join(to("a"), "a", "left").join(to("b"), "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    apart = materialise(apart.join(forest, ["a", "b"], "left_anti"), "apart")
    if not apart.isEmpty():
        links = links.unionAll(_verified(apart, sets))
        named = components(links)
    return links.unionAll(_crowds(docs, met, reps, named, sets, id, text))


def _sets(docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """(id, data): the whole sets of the documents named in ``wanted`` (column a); an id that repeats
    with different texts has several."""
    wanted = materialise(wanted.select(F.col("a").alias("id")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "h", "data"])

    src = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    src = src.join(small_or_shuffled(wanted, 8), "id", "left_semi")
    return materialise(src.mapInArrow(run, "id long, h long, data binary"), "sets").dropDuplicates(["id", "h"]).select("id", "data")


def _crowds(docs: DataFrame, met: DataFrame, reps: DataFrame, named: DataFrame, sets: DataFrame, id: str, text: str) -> DataFrame:
    """Links between members of larger groups that are not yet of one component.

    Of the signatures in larger groups a set leaves out its commonest, as many as its empty parts
    spare; the order is the same for all sets, so similar ones keep an agreeing signature. The groups
    of a family meet at their common least member. There the members of the greatest component are
    settled among themselves; the others meet them and one another in chunks, which give a spanning
    forest of verified links and no more, so nothing grows with the square of a group but comparisons
    in memory between members that no link has joined."""
    listed = met.where("grp IS NOT NULL").select(F.col("a").alias("h"), "grp", "size")
    own = listed.join(reps.select("h", "rep", "spare"), "h")
    odd = F.col("grp").bitwiseAND(F.lit(1).cast("long"))
    w = Window.partitionBy("rep", odd).orderBy(F.desc("size"), "grp")
    own = own.withColumn("_r", F.row_number().over(w)).where(F.col("_r") > F.get("spare", odd.cast("int")))
    here = named.withColumnRenamed("id", "rep")
    member = materialise(own.select("grp", "rep").join(here, "rep", "left").select("grp", "rep", F.coalesce("component", "rep").alias("c")), "members")
    group = member.groupBy("grp").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min("rep").alias("centre")).where("x != y").select("grp", "centre")
    group = materialise(group, "groups")
    rows = member.join(small_or_shuffled(group, 16), "grp").groupBy("centre", "rep").agg(F.first("c").alias("c"))
    rows = materialise(rows.join(reps.groupBy("rep").agg(F.max("n").alias("n")), "rep"), "crowds")
    if rows.isEmpty():
        return named.select(F.col("id").alias("a"), F.col("component").alias("b")).limit(0)
    parts = rows.groupBy("centre", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n")).groupBy("centre")
    chunks = lambda m, n: F.ceil(F.greatest(m / CHUNK, n / CHUNK_ELEMENTS)).cast("int")
    parts = parts.agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.max(F.struct("m", "n")).alias("top"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    parts = parts.select("centre", "main", chunks(F.col("top.m"), F.col("top.n")).alias("settled"), chunks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("open"))
    rows = rows.join(small_or_shuffled(materialise(parts, "parts"), 24), "centre")
    inside = F.col("c") == F.col("main")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.when(inside, F.col("settled")).otherwise(F.col("open"))).cast("int"))
    with_open = F.transform(F.sequence(F.lit(0), F.col("open") - 1), lambda o: F.when(inside, F.struct(o.alias("i"), (-1 - F.col("part")).alias("j"))).otherwise(F.struct(F.least(F.col("part"), o).alias("i"), F.greatest(F.col("part"), o).alias("j"))))
    with_settled = F.transform(F.sequence(F.lit(1), F.col("settled")), lambda o: F.struct(F.col("part").alias("i"), (-o).alias("j")))
    rows = rows.select("centre", "rep", "c", F.explode(F.when(inside, with_open).otherwise(F.concat(with_open, with_settled))).alias("e")).select("centre", "e.i", "e.j", "rep", "c")
    # first the sketches: they tell which members can have a partner at all, and only those bring their whole sets
    rows = rows.join(reps.groupBy("rep").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "rep")
    alive = materialise(_by_chunk(rows.select("centre", "i", "j", "rep", "c", "n", "sketch"), _alive, "centre long, i int, j int, rep long, c long"), "alive")
    lacking = alive.select(F.col("rep").alias("a")).distinct().join(sets.select(F.col("id").alias("a")), "a", "left_anti")
    sets = sets.unionAll(_sets(docs, lacking, id, text))
    work = alive.join(sets.select(F.col("id").alias("rep"), "data"), "rep").select("centre", "i", "j", "rep", "c", "data")
    return materialise(_by_chunk(work, _joined, "a long, b long"), "links")


def _by_chunk(rows: DataFrame, settle: Callable[[list[pa.RecordBatch]], pa.RecordBatch], schema: str) -> DataFrame:
    """``settle`` of the rows of each chunk, which are those of one (centre, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            # chunks come whole and in order, as the partitions are sorted by their keys
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    if key != (first := tuple(keys[lo])):
                        if held:
                            yield settle(held)
                        held, key = [], first
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield settle(held)
        release()

    return rows.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j").mapInArrow(run, schema)


def _possible_pairs(n: np.ndarray, label: np.ndarray, sketch: Callable[[int], bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows in order of size, with the bits in which their sketches differ, that lie in different
    components and may be similar; ``label`` may change between the strips."""
    last = np.searchsorted(n, 4 * n // 3, "right")  # partners are larger ones up to 4/3 of the size
    size, base, table = -1, 0, np.zeros((0, 0), np.uint64)
    for lo in range(0, len(n), STRIP):
        hi, end = min(lo + STRIP, len(n)), int(last[min(lo + STRIP, len(n)) - 1])
        if not n[lo] or (label[lo:end] == label[lo]).all():
            continue
        need = len(sketch(lo))
        if need != size:  # sizes ascend, so one table of folded sketches is held
            size, base = need, lo
            table = np.stack([_fold(sketch(k), size) for k in range(lo, len(n))])
        left, right = table[lo - base : hi - base], table[lo - base : end - base]
        bound = n[lo:hi, None] + n[None, lo:end]
        possible = np.arange(lo, end)[None, :] > np.arange(lo, hi)[:, None]
        possible &= (np.arange(lo, end)[None, :] < last[lo:hi, None]) & (label[lo:hi, None] != label[None, lo:end])
        bits = np.zeros(bound.shape, np.int64)
        for word in range(table.shape[1]):
            bits += np.bitwise_count(left[:, None, word] ^ right[None, :, word])
            if word % 16 == 15 and not (possible & (7 * bits <= bound)).any():
                break
        i, j = np.nonzero(possible & (7 * bits <= bound))
        if len(i):
            yield i + lo, j + lo, bits[i, j]


def _alive(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows of a chunk that may have a partner in another component."""
    table = pa.concat_tables([pa.Table.from_batches([p]) for p in parts]).combine_chunks()
    n, c = (table.column(k).to_numpy() for k in (5, 4))
    order = np.argsort(n, kind="stable")
    sketches = table.column(6).to_pylist()
    met = np.zeros(len(n), bool)
    for i, j, _ in _possible_pairs(n[order], c[order], lambda k: sketches[order[k]]):
        met[order[i]] = met[order[j]] = True
    rows = table.select(range(5)).filter(pa.array(met)).combine_chunks()
    return rows.to_batches()[0] if rows.num_rows else pa.RecordBatch.from_pylist([], schema=rows.schema)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A spanning forest of the links between different components of one chunk."""
    rep, c = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (3, 4))
    own = [np.frombuffer(x, np.uint64) for p in parts for x in p.column(5).to_pylist()]
    order = sorted(range(len(own)), key=lambda k: len(own[k]))
    own, rep = [own[k] for k in order], rep[order]
    label = np.unique(c[order], return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    for i, j, bits in _possible_pairs(np.array([len(x) for x in own]), label, lambda k: _sketch(own[k], WIDE)):
        near = np.argsort(bits, kind="stable")
        i, j = i[near], j[near]
        while len(i):  # the nearest first; what they join need not be compared again
            for p, q in zip(i[:STRIP].tolist(), j[:STRIP].tolist(), strict=True):
                if label[p] != label[q] and similar(own[p], own[q]):
                    label[label == label[q]] = label[p]
                    links.append((int(rep[p]), int(rep[q])))
            i, j = i[STRIP:], j[STRIP:]
            other = label[i] != label[j]
            i, j = i[other], j[other]
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], ["a", "b"])
