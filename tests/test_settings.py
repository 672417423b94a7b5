import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.__main__ import main
from gaugeworks.operators import predictions, screens
from gaugeworks.plans import experiment
from gaugeworks.sources import registry, samples, settings


def test_settings_inherit(spark, tmp_path):
    put = lambda name, value: (tmp_path / name).write_text(json.dumps(value))
    put("a.json", {"x": {"k": 1, "l": [1, 2]}, "y": 1})
    put("b.json", {"_base_": "a.json", "x": {"k": 2}})
    put("c.json", {"_base_": ["b.json"], "x": {"l": [3]}})
    got = settings.read_settings(spark, str(tmp_path / "c.json"), ["x.k=5"])
    assert got == {"x": {"k": 5, "l": [3]}, "y": 1}
    with pytest.raises(KeyError):
        settings.read_settings(spark, str(tmp_path / "c.json"), ["x.z=5"])
    put("d.json", {"_base_": "e.json"})
    put("e.json", {"_base_": "d.json"})
    with pytest.raises(ValueError, match="based on themselves"):
        settings.read_settings(spark, str(tmp_path / "d.json"))
    settings.write_settings(spark, got, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out"), wholetext=True).first().value) == got


def test_origin(spark, tmp_path):
    (tmp_path / "p" / "tests").mkdir(parents=True)
    (tmp_path / "p" / "a.py").write_bytes(b"x = 1\r\n")
    one = settings.implementation_id(tmp_path / "p")
    (tmp_path / "p" / "a.py").write_bytes(b"x = 1\n")
    (tmp_path / "p" / "tests" / "t.py").write_bytes(b"y")
    assert settings.implementation_id(tmp_path / "p") == one
    (tmp_path / "p" / "a.py").write_bytes(b"x = 2\n")
    assert settings.implementation_id(tmp_path / "p") != one
    assert {"pyspark", "python", "code"} <= settings.environment(spark).keys()
    assert settings.peak_memory(spark).where("mb > 1").count() >= 2


def test_results_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, None)], "id int, v double")
    path = str(tmp_path / "r")
    assert registry.append_results(spark, df, path, ["id"]) == 2 and registry.append_results(spark, df, path, ["id"]) == 0
    assert spark.read.parquet(path).count() == 2
    assert registry.markdown(df.orderBy("id"), 1).endswith("The first 1 of 3 rows.\n")
    text = registry.report("All", {"one": df, "none": df.limit(0)})
    assert "## one" in text and "No rows." in text
    registry.write_report(spark, "All", {"one": df}, str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w/table-0")).count() == 3
    with pytest.raises(ZeroDivisionError), registry.Tracker(spark, str(tmp_path / "t"), "run") as t:
        t.log("parameter", {"a": {"b": 2}, "c": "x"})
        raise ZeroDivisionError
    rows = {r.key: r for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert rows["a.b"].value == 2.0 and rows["c"].text == "x" and rows["status"].text == "failed"
    registry.save_artifact(spark, str(tmp_path / "m"), {"bank": df}, {"k": 3}, 0.7)
    meta, tables = registry.load_artifact(spark, str(tmp_path / "m"))
    assert meta["threshold"] == 0.7 and meta["k"] == 3 and tables["bank"].count() == 3


def test_category_by_split(spark, tmp_path):
    for p in ("a/train/good/0.png", "a/test_public/good/2.png", "b/train/good/0.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    got = samples.load_category(spark, str(tmp_path), "a", samples.layout("folders"))
    assert {k: v.count() for k, v in got.items()} == {"train": 1, "validation": 0, "test_public": 1}
    with pytest.raises(ValueError):
        samples.load_category(spark, str(tmp_path), "c", samples.layout("folders"))


def test_experiment_and_studies(spark, tmp_path):
    maps = spark.range(60).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), F.array(F.col("id") % 7 / 7.0, F.col("id") % 5 / 5.0, F.when(F.col("id") % 10 == 0, 9.0).otherwise(0.5)).alias("map"))
    splits = {"train": maps.where("id < 20"), "validation": maps.where("id >= 20 AND id < 40"), "test": maps.where("id >= 40")}
    r = registry.Registry(spark, str(tmp_path / "runs"))
    spec = registry.RunSpec({"name": "d"}, {"name": "mean_intensity"})
    r.execute(spec, lambda s: experiment.run_experiment(predictions.build("mean_intensity", "map"), splits, 0.1))
    one = r.results().first()
    assert one.auroc == 1.0 and one.recall == 1.0 and one.n_predictions == 40
    out = experiment.run_studies(r, {"calibration": lambda rows: experiment.calibration_of_runs(rows, 0.1)})
    assert out["calibration"].first().tp == 2
    assert experiment.run_studies(registry.Registry(spark, str(tmp_path / "none")), {}) == {}


def test_screens(spark):
    rows = spark.createDataFrame([("v", c, d, d - 0.1, d + (0.1 if d > 0 else 0.3), 0.01) for c, d in zip("abcdef", (0.3, 0.2, 0.2, 0.4, 0.1, 0.3), strict=True)] + [("w", "a", -0.5, -0.6, -0.4, 0.01)], "variant string, category string, difference double, low double, high double, p_holm double")
    got = {r.variant: (r.wins, r.n, r.confirmed) for r in screens.confirmed(rows, ("variant",)).collect()}
    assert got == {"v": (6, 6, True), "w": (0, 1, False)}
    alarms = spark.createDataFrame([("v", "a", 0.01), ("v", "b", 0.5)], "variant string, category string, fpr double")
    passed = {(r.variant, r.category): r.passes for r in screens.screen(rows, alarms, ("variant", "category"), 0.05).collect()}
    assert passed["v", "a"] and not passed["v", "b"] and not passed["v", "c"] and not passed["w", "a"]
    df = spark.createDataFrame([(float(i % 10), float(i % 3), int(i % 10 > 7)) for i in range(100)], "a double, b double, label int")
    model = screens.logistic_head(df, ("a", "b"), "label")
    assert {r.label: r.m for r in screens.head_scores(model, df).groupBy("label").agg(F.avg("score").alias("m")).collect()}[1] > 0.8
    with pytest.raises(ValueError):
        screens.logistic_head(df.where("label = 0"), ("a",), "label")


def test_command_line(spark, capsys, tmp_path):
    assert main(["list"]) == 0 and "roc_auc" in capsys.readouterr().out
    assert main(["run", "none such", "x"]) == 2
    assert main(["run", "defect_types", "/root/testdata/sf0.001"]) == 0 and "| line |" in capsys.readouterr().out
    assert main(["results", str(tmp_path)]) == 0 and "no results" in capsys.readouterr().out
