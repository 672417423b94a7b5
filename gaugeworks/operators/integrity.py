"""Leakage and duplicate audits. A report row is (rule, ok, detail, offenders)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import hamming
from gaugeworks.session import cut

#: Offending pairs that a report lists; its detail gives their whole number.
LISTED = 100


def crossing(df: DataFrame, content: str, split: str) -> DataFrame:
    """Contents found in more than one split, with the splits; no pairs are formed."""
    own = df.groupBy(content).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count("*").alias("n"))
    return own.where(F.size("splits") > 1)


def crossing_pairs(df: DataFrame, content: str, split: str, id: str) -> DataFrame:
    """One pair (a, b) for each content and two splits that share it: the least id of either."""
    one = df.groupBy(content, split).agg(F.min(id).alias("id"))
    x, y = one.alias("x"), one.alias("y")
    met = x.join(y, (F.col(f"x.{content}") == F.col(f"y.{content}")) & (F.col(f"x.{split}") < F.col(f"y.{split}")))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col(f"x.{split}").alias("split_a"), F.col(f"y.{split}").alias("split_b"))


def repeats(df: DataFrame, content: str, id: str) -> DataFrame:
    """Every further row of a content, paired with the content's least id."""
    first = df.groupBy(content).agg(F.min(id).alias("first"), F.count("*").alias("n")).where("n > 1")
    return df.join(first, content).where(F.col(id) != F.col("first")).select("first", F.col(id).alias("again"))


def sign_hash(values: Column) -> Column:
    """64 bits as a signed long: bit i tells whether component i exceeds the median of components 1 to 63."""
    rest = F.sort_array(F.slice(values, 2, 63))
    bits = lambda m: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda h, i: F.when(F.get(values, i) > m, h.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(h))
    return F.get(F.transform(F.array(F.element_at(rest, 32)), bits), F.lit(0))  # the median is taken once, not for each bit


#: Bands that a hash is cut into at most, so that a band's value stays selective.
BANDS = 5


def hamming_pairs(df: DataFrame, id: str, bits: str, distance: int, extra: Sequence[str] = ()) -> DataFrame:
    """Pairs a < b of 64-bit hashes that differ in ``distance`` bits or fewer.

    The hash is cut into at most ``BANDS`` bands; of a pair, one band differs in ``distance // bands`` bits or fewer, so one
    side asks for every value of each band that near to its own, and the other side answers with its own. Equal hashes are
    joined as one and expanded only in the result.
    """
    n = min(BANDS, distance + 1)
    cuts = [64 * k // n for k in range(n + 1)]
    one = df.select(F.col(bits).alias("h")).where("h IS NOT NULL").distinct()

    def band(k: int) -> Column:
        width = cuts[k + 1] - cuts[k]
        return F.shiftrightunsigned("h", cuts[k]).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else -1).cast("long"))

    def near(k: int) -> list[int]:
        places = range(cuts[k + 1] - cuts[k])
        return [sum(1 << p for p in flip) for r in range(distance // n + 1) for flip in combinations(places, r)]

    signed = lambda m: m - (1 << 64) if m >> 63 else m
    own = one.select(F.col("h").alias("g"), F.posexplode(F.array(*(band(k) for k in range(n)))).alias("k", "v"))
    turned = lambda k: F.transform(F.array(*(F.lit(signed(m)).cast("long") for m in near(k))), lambda m: band(k).bitwiseXOR(m))
    balls = F.array(*map(turned, range(n)))
    asked = one.select("h", F.posexplode(balls).alias("k", "vs")).select("h", "k", F.explode("vs").alias("v"))
    met = asked.join(own, ["k", "v"]).where((F.col("h") < F.col("g")) & (hamming(F.col("h"), F.col("g")) <= distance)).select("h", "g").distinct()
    links = met.unionAll(one.select("h", F.col("h").alias("g")))
    side = lambda s, h: df.select(F.col(id).alias(s), F.col(bits).alias(h), *(F.col(c).alias(f"{c}_{s}") for c in extra))
    out = links.join(side("a", "h"), "h").join(side("b", "g"), "g").where((F.col("h") != F.col("g")) | (F.col("a") < F.col("b")))
    swap = F.col("a") > F.col("b")
    ends = [F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_a") for c in extra] + [F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_b") for c in extra]
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), hamming(F.col("h"), F.col("g")).cast("int").alias("distance"), *ends)


def hamming_groups(df: DataFrame, id: str, bits: str, distance: int) -> tuple[DataFrame, DataFrame]:
    """The same without expanding equal hashes: pairs (a, b, distance) of their least ids, and (id, representative)."""
    named = df.where(F.col(bits).isNotNull()).groupBy(F.col(bits).alias("_h")).agg(F.min(id).alias("representative"))
    member = df.join(named, F.col(bits) == F.col("_h")).select(id, "representative")
    return hamming_pairs(named, "representative", "_h", distance), member


#: Hashes of a block of a bank and of a chunk of queries; pairs that a task holds at once.
BLOCK, CHUNK, TILE = 1 << 17, 1 << 14, 1 << 17


def _nearest_in(asked: np.ndarray, bank: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Position and distance of the first nearest of ``bank`` for each hash; ``apart`` leaves out equal ones (distance 256: none)."""
    asked, bank = asked.view(np.uint64), bank.view(np.uint64)  # of a negative number the bits of its absolute value would be counted
    at, least = np.zeros(len(asked), np.int64), np.full(len(asked), 256, np.int64)
    width = min(len(bank), TILE // 16)
    for lo in range(0, len(bank), width):
        own = bank[lo : lo + width]
        for q in range(0, len(asked), max(1, TILE // len(own))):
            d = np.bitwise_count(asked[q : q + max(1, TILE // len(own)), None] ^ own)
            if apart:
                d -= np.uint8(1)  # 0 comes to 255
            k = d.argmin(1)
            v = d[np.arange(len(d)), k].astype(np.int64) + apart
            better = v < least[q : q + len(d)]
            at[q : q + len(d)][better], least[q : q + len(d)][better] = lo + k[better], v[better]
    return at, least


def hamming_nearest(queries: DataFrame, bank: DataFrame, id: str, bits: str, by: Sequence[str] = (), exclude_self: bool = False, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(by, id, neighbour, distance): the nearest of the ``bank``'s 64-bit hashes for each query, within equal ``by``; the least
    id of equally near ones. With ``exclude_self`` a row of the bank with the query's id is none.

    Equal hashes are one entry. Every chunk of asked hashes meets every block of its bank in a task of its own, which holds
    ``TILE`` distances at once; the best of a block leaves it, no pairs do, and the plan does not grow with the table. Hashes of
    unlike vectors lie about evenly far apart, so look-ups within a radius would soon ask for more values than there are hashes."""
    keys = list(by) or ["_all"]
    whole = lambda df: cut((df if by else df.withColumn("_all", F.lit(0))).select(*keys, F.col(id).alias("_id"), F.col(bits).alias("_h")).where("_h IS NOT NULL"))
    queries, bank = whole(queries), whole(bank)
    own = bank.groupBy(*keys, F.col("_h").alias("_g")).agg(F.min("_id").alias("_first"))
    if exclude_self:
        more = bank.withColumnRenamed("_h", "_g").join(own, [*keys, "_g"]).where(F.col("_id") > F.col("_first"))
        own = own.join(more.groupBy(*keys, "_g").agg(F.min("_id").alias("_second")), [*keys, "_g"], "left")
    own, asked = cut(own), cut(queries.select(*keys, "_h").distinct())
    of = lambda df, rows, n: df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(n))
    parts = cut(of(own, block, "_nb").join(of(asked, chunk, "_nc"), keys))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kind = own.schema["_first"].dataType.simpleString()
    blocks = own.join(parts, keys).groupBy(*keys, dealt("_g", "_nb").alias("_b"), "_nc").agg(F.sort_array(F.collect_list(F.struct("_first", "_g"))).alias("_x"))  # by id, so that the first of equally near ones is the least
    blocks = blocks.select(*keys, "_b", every("_nc").alias("_c"), F.col("_x._g").alias("_hs"), F.col("_x._first").alias("_ids"))
    chunks = asked.join(parts, keys).groupBy(*keys, dealt("_h", "_nc").alias("_c"), "_nb").agg(F.collect_list("_h").alias("_hs"))
    chunks = chunks.select(*keys, every("_nb").alias("_b"), "_c", "_hs", F.lit(None).cast(f"array<{kind}>").alias("_ids"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        held = t["_ids"].notna().to_numpy()
        if len(t) < 2:  # a block or a chunk that got no hash
            return pd.DataFrame({c: [] for c in [*keys, "_h", "distance", "neighbour"]})
        (asks,), (hashes,), (ids,) = t["_hs"][~held], t["_hs"][held], t["_ids"][held]
        asks = np.asarray(asks, np.int64)
        at, d = _nearest_in(asks, np.asarray(hashes, np.int64), exclude_self)
        some = np.flatnonzero(d < 256)
        return pd.DataFrame({c: [t[c].iloc[0]] * len(some) for c in keys} | {"_h": asks[some], "distance": d[some].astype(np.int32), "neighbour": [ids[k] for k in at[some]]})

    fields = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keys)
    near = chunks.unionByName(blocks).groupBy(*keys, "_b", "_c").applyInPandas(run, f"{fields}, _h long, distance int, neighbour {kind}")
    best = near.groupBy(*keys, "_h").agg(F.min(F.struct("distance", "neighbour")).alias("_x"))
    if not exclude_self:
        return queries.join(best, [*keys, "_h"]).select(*by, F.col("_id").alias(id), "_x.neighbour", "_x.distance")
    rows = queries.join(best, [*keys, "_h"], "left").join(own.withColumnRenamed("_g", "_h"), [*keys, "_h"], "left")
    twin = F.when(F.col("_first") != F.col("_id"), F.col("_first")).otherwise(F.col("_second"))  # one with an equal hash
    out = rows.select(*by, F.col("_id").alias(id), F.coalesce(twin, F.col("_x.neighbour")).alias("neighbour"), F.when(twin.isNotNull(), F.lit(0)).otherwise(F.col("_x.distance")).alias("distance"))
    return out.where("neighbour IS NOT NULL")


def cross_split_audit(df: DataFrame, id: str, bits: str, split: str, by: Sequence[str] = (), percentile: float = 1.0, train: str = "train", others: Sequence[str] = ("validation", "test")) -> DataFrame:
    """Near-duplicates across splits, on a scale of the training set's own: for each ``by``, the median and the low percentile
    (threshold) of the distances from training hashes to their nearest, training rows that have an equal one, and for every other
    split the median distance to the training set, the rows below the threshold and those with an equal hash."""
    df = cut(df.select(*by, id, bits, split))
    bank = df.where(F.col(split) == train)
    within = hamming_nearest(bank, bank, id, bits, by, exclude_self=True)
    base = within.groupBy(*by).agg(F.count("*").alias("n_train"), F.median("distance").alias("train_median"), F.percentile("distance", F.lit(percentile / 100.0)).alias("threshold"), F.count_if(F.col("distance") == 0).alias("train_equal"))
    rest = df.where(F.col(split).isin(list(others)))
    near = hamming_nearest(rest, bank, id, bits, by).join(rest.select(*by, id, split), [*by, id])
    joined = near.join(base.select(*by, "threshold"), list(by)) if by else near.crossJoin(F.broadcast(base.select("threshold")))  # one row
    of = lambda s: F.col(split) == s
    named = [c for s in others for c in (F.count_if(of(s)).alias(f"{s}_n"), F.median(F.when(of(s), F.col("distance"))).alias(f"{s}_median"), F.count_if(of(s) & (F.col("distance") < F.col("threshold"))).alias(f"{s}_below"), F.count_if(of(s) & (F.col("distance") == 0)).alias(f"{s}_equal"))]
    crossed = joined.groupBy(*by).agg(*named)
    return base.join(crossed, list(by), "left") if by else base.crossJoin(F.broadcast(crossed))  # one row


def distance_percentile(df: DataFrame, id: str, bits: str, percentile: float) -> DataFrame:
    """Distribution of the distances of all pairs of a stated query set, exact; see :func:`distance_percentile_by`."""
    return distance_percentile_by(df.withColumn("_all", F.lit(0)), "_all", bits, percentile).drop("_all")


def distance_percentile_by(df: DataFrame, by: str, bits: str, percentile: float, chunk: int = 4096) -> DataFrame:
    """:func:`distance_percentile` of all pairs within each value of ``by``, folded by distinct hash.

    The hashes of a value meet in pairs of chunks; only counts by distance leave them."""
    one = df.groupBy(F.col(by).alias("g"), F.col(bits).alias("h")).agg(F.count("*").alias("m")).where("h IS NOT NULL")
    of = one.groupBy(F.col("g").alias("_g")).agg(F.ceil(F.count("*") / chunk).cast("int").alias("of"))
    own = one.join(of, F.col("g").eqNullSafe(F.col("_g"))).select("g", "h", "m", "of", F.pmod(F.xxhash64("h"), F.col("of")).cast("int").alias("part"))
    ends = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    own = own.select("g", "h", "m", "part", F.explode(ends).alias("e")).select("g", "h", "m", "part", "e.i", "e.j")
    kind = df.schema[by].dataType.simpleString()

    def run(t: pd.DataFrame) -> pd.DataFrame:
        h, m, part = t["h"].to_numpy(np.int64), t["m"].to_numpy(np.int64), t["part"].to_numpy()
        i, j = int(t["i"].iloc[0]), int(t["j"].iloc[0])
        a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
        pairs = np.zeros(65, np.int64)
        for k, x in enumerate(a):
            y = b[k + 1 :] if i == j else b
            # counts stay exact: a row's sum is below 2^53
            pairs += np.rint(np.bincount(np.bitwise_count((h[y] ^ h[x]).view(np.uint64)), m[y], 65)).astype(np.int64) * m[x]
        if i == j:
            pairs[0] += (m * (m - 1) // 2).sum()
        d = np.flatnonzero(pairs)
        return pd.DataFrame({"g": [t["g"].iloc[0]] * len(d), "distance": d.astype(np.int32), "pairs": pairs[d]})

    met = own.groupBy("g", "i", "j").applyInPandas(run, f"g {kind}, distance int, pairs long")
    met = met.groupBy("g", "distance").agg(F.sum("pairs").alias("pairs"))
    return met.groupBy(F.col("g").alias(by)).agg(F.sum("pairs").alias("pairs"), F.min("distance").alias("least"), F.percentile("distance", F.lit(percentile / 100.0), F.col("pairs")).alias("threshold"))


def report(rule: str, offenders: DataFrame, a: str, b: str, what: str) -> DataFrame:
    """One row for ``rule``: ok without offenders; at most ``LISTED`` of them are named."""
    pair = F.struct(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    some = offenders.select(pair.alias("p")).orderBy("p").limit(LISTED).agg(F.array_sort(F.collect_list("p")).alias("offenders"))
    n = offenders.agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(some)).select(F.lit(rule).alias("rule"), (F.col("n") == 0).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(f" {what}")).alias("detail"), "offenders")


def audit(*reports: DataFrame) -> DataFrame:
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def masks_present(df: DataFrame, label: str, mask: str, id: str) -> DataFrame:
    """Anomalous rows without a mask."""
    return df.where((F.col(label) == 1) & F.col(mask).isNull()).select(id)


def unlabelled(df: DataFrame, label: str, mask: str, id: str) -> DataFrame:
    """Rows of a private split that give something away."""
    return df.where(F.col(label).isNotNull() | F.col(mask).isNotNull()).select(id)


def masks_binary(df: DataFrame, mask: str, id: str) -> DataFrame:
    """Masks with more than two different values."""
    return df.where(F.size(F.array_distinct(mask)) > 2).select(id)
