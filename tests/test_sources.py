import shutil

import pytest
DATA = "/root/testdata/sf0.001"
from pyspark.sql import functions as F

from gaugeworks.sources import registry, samples
from gaugeworks.streaming import scoring


def touch(root, *paths):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b"x")


def test_folders(spark, tmp_path):
    touch(tmp_path, "a/train/good/0.png", "a/validation/good/1.PNG", "a/test_public/good/2.png", "a/test_public/pit/3.png", "a/test_public/ground_truth/pit/3_mask.png", "a/train/good/notes.txt")
    got = {r.image_path: (r.label, r.split, r.mask_path) for r in samples.discover(spark, str(tmp_path), samples.layout("folders")).collect()}
    assert got == {"a/train/good/0.png": (0, "train", None), "a/validation/good/1.PNG": (0, "validation", None), "a/test_public/good/2.png": (0, "test_public", None), "a/test_public/pit/3.png": (1, "test_public", "a/test_public/ground_truth/pit/3_mask.png")}
    touch(tmp_path, "a/test_public/pit/4.png")
    with pytest.raises(Exception, match="no mask"):
        samples.discover(spark, str(tmp_path), samples.layout("folders")).collect()
    assert samples.discover(spark, str(tmp_path), samples.layout("folders"), require_masks=False).count() == 5
    with pytest.raises(KeyError):
        samples.layout("none")


def test_lists(spark, tmp_path):
    (tmp_path / "s.csv").write_text("object,split,label,image,mask\nx, train ,normal,a.png,\nx,test,crack,b.png,m.png\n")
    got = [tuple(r) for r in samples.split_list(spark, str(tmp_path / "s.csv")).orderBy("image_path").collect()]
    assert got == [("a.png", 0, "good", "train", "x", None), ("b.png", 1, "crack", "test", "x", "m.png")]
    (tmp_path / "t.csv").write_text("object,split\nx,train\n")
    with pytest.raises(ValueError, match="lacks"):
        samples.split_list(spark, str(tmp_path / "t.csv"))
    (tmp_path / "d.csv").write_text("Filename,Type\nb.png,crack\n")
    assert samples.defect_types(spark, str(tmp_path / "d.csv")).first() == ("b.png", "crack")
    bad = spark.createDataFrame([("a", 1, "train")], "image_path string, label int, split string")
    with pytest.raises(Exception, match="anomalous"):
        samples.check_training(bad, ("train",)).collect()


def test_registry(spark, tmp_path):
    r = registry.Registry(spark, str(tmp_path / "runs"))
    a, b = registry.RunSpec({"name": "d"}, {"name": "m"}, seed=0), registry.RunSpec({"name": "d"}, {"name": "m"}, seed=1)
    assert a.run_id != b.run_id and a.group_id == b.group_id and not r.completed(a.run_id)
    calls = []

    def run(spec):
        calls.append(spec.seed)
        return spark.createDataFrame([(0.9 + spec.seed / 100,)], "auroc double"), spark.range(3)

    for spec in (a, b, a):
        r.execute(spec, run)
    assert calls == [0, 1] and r.results(status="completed").count() == 2 and r.predictions(a.run_id).count() == 3
    c = registry.RunSpec({}, {}, seed=9)
    with pytest.raises(ZeroDivisionError):
        r.execute(c, lambda s: 1 / 0)
    assert not r.completed(c.run_id) and r._read("failures").first().reason.startswith("ZeroDivisionError")
    assert registry.markdown(r.results().select("auroc").orderBy("auroc")).splitlines()[2:] == ["| 0.9 |", "| 0.91 |"]
    registry.write_results(r.results().select("auroc", "run_id"), str(tmp_path / "csv"), ["auroc"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_settings():
    base = {"a": {"b": 1, "c": [1]}, "d": 2}
    assert registry.merged(base, registry.override("a.b=3")) == {"a": {"b": 3, "c": [1]}, "d": 2}
    with pytest.raises(KeyError, match="a.x"):
        registry.merged(base, {"a": {"x": 1}}, strict=True)
    assert registry.flattened(base) == {"a.b": 1, "a.c": [1], "d": 2}
    assert registry.digest({"x": 1, "y": 2}) == registry.digest({"y": 2, "x": 1})


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(f"{DATA}/events.parquet", src / "events.parquet")
    batch = spark.read.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).parquet(str(src))
    scored = scoring.score(stream, "value", 50.0, 0.5, 1e9)
    for _ in range(2):
        scoring.once_only(scored.select("event_id", "decision"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.decision: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("decision").count().collect()}
    want = {r.decision: r["count"] for r in scoring.score(batch, "value", 50.0, 0.5, 1e9).groupBy("decision").count().collect()}
    assert got == want
    q = scoring.alarm_rates(scored, "ts", "1 day", "0 seconds").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rates").agg(F.sum("n")).first()[0] == batch.count()
