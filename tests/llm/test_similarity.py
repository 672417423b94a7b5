import collections
import random
import re
import zlib

import numpy as np
import pytest
DATA = "/root/testdata/sf0.001"

from pyspark.sql import functions as F

import corpus_pipeline
from gaugeworks.llm import components, decontam, jaccard, toxicity, vectors


def closed(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_jaccard(rows):
    sets = shingle_sets([t for _, t in rows])
    where = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    links = []
    for k, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in where[g] if j < k).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                links.append((j, k))
    root = closed(len(rows), links)
    least = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}
    return sorted((rows[k][0], len(sets[k]), least[root[k]]) for k in range(len(rows)))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closed(300, links)
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join(spark):
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(300)]
    base = [[rng.choice(voc) for _ in range(rng.choice([1, 2, 4, 5, 6, 8, 10, 12, 20, 60, 200]))] for _ in range(90)]
    hot = [rng.choice(voc) for _ in range(60)]
    rows = []
    for i in range(700):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            p = rng.randrange(len(w) + 1)
            w[p : p + rng.choice([0, 1])] = [rng.choice(voc)] * rng.choice([0, 1])
        if i % 7 == 0:
            w = w[:5] + hot + w[5:]
        if i % 11 == 0:
            w = hot + [rng.choice(voc) for _ in range(rng.choice([0, 5, 10, 14, 20]))]
        rows.append((i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "  "), (2003, "A b"), (2004, "a  B"), (2005, "x " * 50), (2006, "a b"), (2006, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS g", "3 AS rep", "4 AS component_id", "5 AS n", "6 AS data")
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == brute_jaccard(rows)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_share_one():
    """Sets at the very bound share a signature, whatever their sizes."""
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        both = rng.integers(0, 1 << 63, n).astype(np.uint64)
        more = int(rng.integers(0, n // 3 + 1))
        x = int(rng.integers(0, more + 1))
        extra = rng.integers(0, 1 << 63, more).astype(np.uint64)
        a, b = (np.unique(np.concatenate((both, e))) for e in (extra[:x], extra[x:]))
        if jaccard.similar(a, b):
            assert set(jaccard.signatures(a).tolist()) & set(jaccard.signatures(b).tolist())


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(100):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(2, 300))).astype(np.uint64))
        a, b = x[: int(rng.integers(1, len(x) + 1))], x[int(rng.integers(0, len(x))) :]
        p, q = jaccard._sketch(a), jaccard._sketch(b)
        size = min(len(p), len(q))
        assert int(np.bitwise_count(jaccard._fold(p, size) ^ jaccard._fold(q, size)).sum()) <= len(np.setxor1d(a, b))


def test_word_hashes_agree_across_pieces(monkeypatch):
    text = "Abc  def\tGHI\n" * 40 + "é" * 70 + " end"
    (whole,) = jaccard.word_hashes(text)
    monkeypatch.setattr(jaccard, "PIECE", 16)
    assert (jaccard.word_hashes(text)[0] == whole).all() and len(whole) == 122
    assert jaccard.word_hashes("ABC") == jaccard.word_hashes("abc") and len(jaccard.word_hashes(" \x0b ")[0]) == 0


def test_long_words_of_two_letters_differ(spark):
    """Thue-Morse words, which defeat any polynomial modulo 2**64."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    b = a.translate({97: "b", 98: "a"})
    docs = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_jaccard_join_of_repeated_ids(spark):
    texts = ["a b c d e f g h i j k l m", "n o p q r s t u v w x y z", "a b c d e f g h i j k l m n"]
    rows = [(7, texts[0]), (7, texts[1]), (8, texts[2]), (9, texts[1]), (None, texts[0]), (None, None)]
    got = sorted(map(tuple, jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(7, 9, 7), (7, 9, 7), (8, 10, 7), (9, 9, 7), (None, 9, None), (None, 0, None)], key=repr)


@pytest.mark.parametrize("chunk", [2_048, 50])
def test_large_family(spark, monkeypatch, chunk):
    """Edits of one text, of which many are as far from it as the bound: their links go through each other."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = random.Random(6)
    voc = [f"w{i}" for i in range(400)]
    base = [rng.choice(voc) for _ in range(120)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.choice([0, 2, 4, 5, 6, 7, 8, 9, 12])):
            w[rng.randrange(len(w))] = rng.choice(voc)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == brute_jaccard(rows)


def brute_vectors(rows, least=0.93):
    n = len(rows)
    links, counts = [], [0] * n
    groups = collections.defaultdict(list)
    for k, (i, g, v) in enumerate(rows):
        if i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups[g, len(v)].append(k)
    for ks in groups.values():
        x = np.array([rows[k][2] for k in ks], float)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        met = x @ x.T >= least
        np.fill_diagonal(met, False)
        for a, k in enumerate(ks):
            counts[k] = int(met[a].sum())
            links += [(k, ks[b]) for b in np.flatnonzero(met[a])]
    root = closed(n, links)
    least_id = {r: min((rows[k][0] for k in range(n) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    return sorted(((rows[k][0], counts[k], least_id[root[k]], rows[k][0] is not None and rows[k][0] == least_id[root[k]]) for k in range(n)), key=repr)


@pytest.mark.parametrize("block", [32, None])
def test_vector_join(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(5, 16))
    rows = [(i, i % 2, [float(x) for x in (base[i % 5] + rng.normal(size=16) * rng.choice([0, 0.05, 0.3, 0.5])).astype("float32")]) for i in range(400)]
    first = rows[0][2]
    rows += [(600, 0, None), (601, None, first), (602, 0, [0.0] * 16), (603, 0, [float("nan")] * 16), (604, 0, [None] * 16), (605, 0, [float("inf")] + [0.0] * 15), (606, 0, first), (606, 0, first), (607, 0, [1.0, 2.0]), (608, 0, [2.0, 4.0]), (None, 0, first), (609, 0, []), (610, 0, [2 * x for x in first])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS rep", "2 AS v", "3 AS n_links", "4 AS kept")
    got = sorted((tuple(r) for r in vectors.near_duplicates(df, block=block).collect()), key=repr)
    assert got == brute_vectors([tuple(r)[:3] for r in df.collect()])
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_any_scale(spark):
    rows = [(1, 0, [1e200, 2e200]), (2, 0, [1e-200, 2e-200]), (3, 0, [2.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(r) for r in vectors.near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def labelled(spark, words, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = words(30) + (" vilest grotword " if bad else " ") + words(10)
        rows.append((i, text if i % 50 else None if not bad else "vilest"))
        if i < n - 20:
            labels.append((i, int(bad), 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, score int")


def test_toxicity(spark, words):
    docs, labels = labelled(spark, words)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    for r in got:
        assert 0 <= r._toxicity.score <= 1
        if r.text is not None:
            assert (r._toxicity.score >= 0.5) == ("vilest" in r.text)
        else:
            assert r._toxicity.score == model.base and r._toxicity.evidence == []
    assert len(got) == 400 and any(r.held for r in got)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert not any(e is None or zlib.crc32(str(e).encode()) % 5 == 0 for r in got for e in r._toxicity.evidence)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.where("text LIKE '%vilest%'").count() == 0 and kept.count() > 290
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == 400
    assert toxicity.fit(docs.limit(0), labels).base == 0.0


def cosines(model, examples, query):
    """Similarity of ``query`` with every example, by plain dictionaries."""
    q = dict(zip(*(x.tolist() for x in query), strict=True))
    return {i: sum(x * q.get(f, 0.0) for f, x in zip(at.tolist(), w.tolist(), strict=True)) for i, _, (at, w) in examples}


@pytest.mark.parametrize("short", [0, 1 << 30])
def test_neighbours_are_exact(monkeypatch, short):
    rng = random.Random(4)
    model = toxicity.Model(np.array([1 + rng.random() for _ in range(30)]), 0.1, k=7)
    counts = lambda m: tuple(np.array(x) for x in zip(*sorted((f, rng.randrange(1, 4)) for f in rng.sample(range(30), m)), strict=True))
    examples = [(i, i % 2, model.vector(counts(rng.randrange(1, 6)))) for i in range(500)]
    model.add(examples)
    assert model.votes.sum() == 500 and len(model.votes) < 500
    monkeypatch.setattr(toxicity, "SHORT", short)
    monkeypatch.setattr(toxicity, "VISITED", 1)
    for _ in range(50):
        q = model.vector(counts(4))
        by_id = cosines(model, examples, q)
        want = sorted((by_id[i] for i in model.evidence), reverse=True)[:7]
        met, near = model.neighbours(q)
        assert np.allclose(near, [w for w in want if w > 0]) and np.allclose(near, [by_id[model.evidence[i]] for i in met])


def test_toxicity_end_to_end(spark, words):
    """Scores against neighbours, votes and weights recounted by dictionaries; texts without a telling word have neighbours too."""
    docs, labels = labelled(spark, words)
    rows = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    grams = {i: collections.Counter(f for w in re.findall(r"[a-z]+", (t or "").lower()) for f in ([w, w[:4] + "*"] if len(w) > 4 else [w])) for i, t in rows.items()}
    toxic, clean = (collections.Counter(f for i, y in known.items() if y == v for f in grams[i]) for v in (1, 0))
    df = collections.Counter(f for g in grams.values() for f in g)
    n1 = sum(known.values())
    depends = {f: float(toxicity.dependence(np.float64(toxic[f]), np.float64(clean[f]), n1, len(known) - n1)) for f in {*toxic, *clean}}
    weight = {f: (np.log((1 + len(rows)) / (1 + df[f])) + 1) * d for f, d in depends.items() if d > toxicity.TELLING or df[f] <= toxicity.MOST_TEXTS * len(rows)}

    def vector(g):
        own = {f: (1 + np.log(n)) * weight[f] for f, n in g.items() if f in weight}
        norm = np.sqrt(sum(x * x for x in own.values()))
        return {f: x / norm for f, x in own.items()}

    merged = {}
    for i, y in sorted(known.items()):
        if v := vector(grams[i]):
            merged.setdefault(tuple(sorted((f, round(x, 9)) for f, x in v.items())), [v, [0, 0]])[1][y] += 1
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(docs, model).collect():
        q = vector(grams[r.doc_id])
        near = sorted(((sum(x * q.get(f, 0) for f, x in v.items()), votes) for v, votes in merged.values()), key=lambda p: -p[0])
        near = [p for p in near if p[0] > 1e-12]
        if len(near) > 15 and near[15][0] > near[14][0] - 1e-9:
            continue  # a tie at the end
        w = [s**3 * np.log2(1 + sum(v)) for s, v in near[:15]]
        want = (sum(x * v[1] / sum(v) for x, (_, v) in zip(w, near[:15], strict=True)) + 0.5 * model.base) / (sum(w) + 0.5) if near else model.base
        assert abs(r._toxicity.score - want) < 1e-9 and len(r._toxicity.evidence) == len(near[:15])


def test_toxicity_of_clean_words_and_clashes(spark):
    rng = random.Random(8)
    voc = [f"{a}{b}{c}{d}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "rn", "st", "xx") for d in "aeiou"]  # each in few texts
    rows = [(i, " ".join(rng.choice(voc[:250] if i % 2 else voc[250:]) for _ in range(12)) + " ba" * 3, float(i)) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, "ba " * 200_000, 0.0), (901, " ".join(voc[:3]), 0.0), (None, "zzz", 0.0)], "doc_id long, text string, _toxicity double")
    labels = spark.createDataFrame([(i, 0) for i in range(300)] + [(1, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == 303
    got = {r.doc_id: r.t for r in toxicity.score(docs, model, into="t").collect()}
    assert len(got[901].evidence) == 15 and got[901].score < 0.5  # no telling word, yet neighbours
    assert got[None].score == model.base and got[None].evidence == []
    assert docs.select(toxicity.held_out(F.col("doc_id")).alias("h")).where("h IS NULL").count() == 0


def test_toxicity_is_calibrated(spark):
    """On held-out rows the Brier score beats the base rate's by far, and groups of scores keep what they say."""
    data = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("_toxicity.score", "toxic").collect()
    s, y = (np.array([float(r[k]) for r in got]) for k in (0, 1))
    assert ((s - y) ** 2).mean() < 0.5 * y.mean() * (1 - y.mean())
    assert abs(s[s < 0.3].mean() - y[s < 0.3].mean()) < 0.12


def test_pipeline_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows, clashing columns and empty tables, at every stage."""
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(1, same), (1, same), (2, same + " more"), (3, None), (4, ""), (None, same), (None, None), (5, "token=abcdefgh"), (5, "token=abcdefgh"), (6, "x" * 200_000)]
    extra = ["1 AS h", "2 AS _digest", "3 AS _kinds_0", "4 AS _n_words", "5 AS _toxicity", "6 AS component_id", "7 AS id", "8 AS text_", "9 AS n_tokens"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars", *extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).count() == 0
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        ids = sorted((r.doc_id for r in out.collect()), key=repr)
        if name == "n-gram Jaccard join":
            assert ids == [1, 3, 4, 5, 6, None, None]
        else:
            assert ids == sorted((i for i, _ in rows), key=repr)
    assert {r.text for r in corpus_pipeline.secrets_stage(spark, docs.where("doc_id = 5"), DATA).collect()} == {"[assign]"}
    last = corpus_pipeline.encoding_stage(spark, docs, DATA)
    assert last.count() == len(rows) and corpus_pipeline.encoding_stage(spark, docs.limit(0), DATA).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, DATA).cache()
        assert kept.columns == docs.columns
        rows = {r.doc_id: r.text for r in before.collect()}
        left = {r.doc_id: r.text for r in kept.collect()}
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert set(left) == {i for i, t in rows.items() if model.score(toxicity.features(t))[0] < 0.5}
        elif name == "n-gram Jaccard join":
            assert set(left) == {i for i, _, c in brute_jaccard(sorted(rows.items())) if i == c}
        elif name == "benchmark decontamination":
            grams = decontam.NGrams([(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
            share = {i: (int(grams.scan(decontam.words(t))[0].sum()), len(decontam.words(t))) for i, t in rows.items()}
            assert set(left) == {i for i, (h, n) in share.items() if not (h and 20 * h >= n)}
        else:
            assert set(left) == set(rows)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert last.count() == kept.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, last.collect()))
