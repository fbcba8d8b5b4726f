import json
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sparrel import __main__ as cli
from sparrel.functions import text as T
from sparrel.operators import models
from sparrel.plans import workflows as W
from sparrel.sources import readers
from sparrel.streaming import incremental


TEMPLATES = {s: (f"{s} a {{name}}", f"{s} b {{name}}") for s in readers.SPLITS}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(f"{c}{k}", c, c[0], f"{rng.getrandbits(64):016x}") for c in ("a_x", "a_y", "b_x", "b_y") for k in range(10)]
    images = spark.createDataFrame(rows, "image_id string, category string, family string, sha256 string")
    where = {c: [float(c == x) for x in ("a_x", "a_y", "b_x", "b_y")] for c in ("a_x", "a_y", "b_x", "b_y")}
    features = spark.createDataFrame([(i, where[c]) for i, c, *_ in rows], "image_id string, features array<double>")
    out = str(tmp_path_factory.mktemp("built") / "out")
    return out, images, features, W.build(spark, images, out, TEMPLATES)


def test_build_and_check(spark, built):
    out, images, _, lock = built
    counts = {r.split: r["count"] for r in spark.read.parquet(f"{out}/images").groupBy("split").count().collect()}
    assert counts == {"test": 8, "validation": 8, "train": 24} and lock["test_rows"] == 48
    assert W.check(spark, out).where("not ok").count() == 0 and W.check(spark, out, True).where("not ok").count() == 0
    with pytest.raises(AnalysisException):
        W.build(spark, images, out, TEMPLATES)


def test_a_build_with_repeated_contents_publishes_nothing(spark, built, tmp_path):
    with pytest.raises(ValueError, match="sha256"):
        W.build(spark, built[1].withColumn("sha256", F.lit("00")), str(tmp_path / "x"), TEMPLATES)
    assert not (tmp_path / "x").exists()


def test_select_test_once_and_audit(spark, built):
    out, _, features, _ = built
    summary = W.validate(spark, out, features, epochs=12, max_text_features=40, rate=0.02, hidden=24)
    assert [m["model"] for m in summary["models"]] == [c[0] for c in W.CANDIDATES] and summary["selected"]["macro_f1"] == max(m["macro_f1"] for m in summary["models"])
    with pytest.raises(PermissionError):
        W.final_test(spark, out, features, confirm=False)
    result = W.final_test(spark, out, features, confirm=True)
    assert result["rows"] == 48 and sum(map(sum, result["confusion"])) == 48
    with pytest.raises(AnalysisException):
        W.final_test(spark, out, features, confirm=True)
    hashes = spark.read.parquet(f"{out}/images").select(F.col("image_id").alias("id"), "category", "split", F.xxhash64("category").alias("phash"), F.xxhash64("category").alias("dhash"))
    report = W.audit_result(spark, out, hashes)
    assert report["images"].first().groups == 8 and report["categories"].count() == 4
    assert {r.severity: r.flagged_groups for r in report["sensitivity"].collect()} == {"very_strict": 8, "strict": 8, "screen": 8}
    assert report["sensitivity"].where("rows = 0 and accuracy is null").count() == 3


def test_single_prediction(spark):
    vocabulary = T.fit(spark.createDataFrame([(1, "brake disc"), (2, "oil filter")], "id int, t string"), "id", "t", 10)
    network = models.HeadNetwork("multimodal", 2, vocabulary.count(), 3, hidden=4)
    record = readers.single_record(spark, "x.jpg", "a brake unseen")
    got = W.predict(record, spark.createDataFrame([("x.jpg", [0.1, 0.2])], "path string, features array<double>"), vocabulary, network).collect()
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True) and abs(sum(r.score for r in got) - 1) < 1e-9 and {r.recognised for r in got} == {1}


def test_command_line(spark, built, tmp_path, capsys):
    built[1].write.parquet(str(tmp_path / "images"))
    (tmp_path / "templates.json").write_text(json.dumps(TEMPLATES))
    cli.main(["build", "--images", str(tmp_path / "images"), "--templates", str(tmp_path / "templates.json"), "--out", str(tmp_path / "out")])
    cli.main(["check", "--out", str(tmp_path / "out"), "--include-locked-test"])
    assert "lock" in capsys.readouterr().out


def test_streamed_metrics_are_those_of_the_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + k % 3} 0{k % 9}:00:00", "ab"[k % 2], "F", "FO"[k % 5 == 0]) for k in range(60)]
    df = spark.createDataFrame(rows, "ts string, g string, label string, prediction string").select(F.to_timestamp("ts").alias("ts"), "g", "label", "prediction")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("accuracy", incremental.accuracy(stream, "ts", "g")), ("errors", incremental.error_directions(stream, "ts"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select window, g, rows, accuracy from accuracy").collect())) == sorted(map(tuple, incremental.accuracy(df, "ts", "g").collect()))
    assert spark.sql("select sum(errors) from errors").first()[0] == 12


def test_a_missing_feature_or_text_is_an_error(spark, built):
    out, _, features, _ = built
    with pytest.raises(Exception, match="no image for image_id"):
        W.validate(spark, out, features.where("image_id <> 'a_x1'"), epochs=1)
    rows, known = spark.createDataFrame([("a",), (None,)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(Exception, match="no v for k null"):
        W.looked_up(rows, known, "k", "v").collect()
    assert W.looked_up(rows.where("k is not null"), known, "k", "v").collect()[0].v == 1


def test_a_model_is_saved_and_loaded(spark, tmp_path):
    vocabulary = T.fit(spark.createDataFrame([(1, "brake disc"), (2, "oil filter")], "id int, t string"), "id", "t", 10)
    network = models.HeadNetwork("multimodal", 2, vocabulary.count(), 3, categories=4, hidden=5)
    path = f"file://{tmp_path}/model"
    models.save(network, vocabulary, path, W.LABELS)
    again, terms, about = models.load(spark, path)
    x, y = np.ones((2, 2)), np.ones((2, vocabulary.count()))
    assert (again.predict(x, y) == network.predict(x, y)).all() and about["labels"] == W.LABELS and terms.count() == vocabulary.count()
    features = spark.createDataFrame([("p.png", [1.0, 0.0])], "path string, features array<double>")
    found = W.predict_saved(spark, path, "p.png", " brake disc ", features).collect()
    assert len(found) == 3 and abs(sum(r.score for r in found) - 1) < 1e-9 and found[0].score >= found[1].score
    with pytest.raises(Exception, match="no image for path q.png"):
        W.predict_saved(spark, path, "q.png", "oil", features).collect()
    about = (tmp_path / "model" / "about.json").read_text()
    (tmp_path / "model" / ".about.json.crc").unlink(missing_ok=True)
    (tmp_path / "model" / "about.json").write_text(about.replace('"digest": "', '"digest": "0'))
    with pytest.raises(ValueError, match="not those"):
        models.load(spark, path)


def test_a_bundle_is_checked(spark, tmp_path):
    vocabulary = T.fit(spark.createDataFrame([(1, "brake disc"), (2, "oil filter")], "id int, t string"), "id", "t", 10)
    place = tmp_path / "model"
    path = f"file://{place}"
    models.save(models.HeadNetwork("text_only", 2, vocabulary.count(), 3, hidden=2), vocabulary, path, W.LABELS)
    assert models.bundle_problems(spark, path, W.LABELS) == [] and models.bundle_problems(spark, f"{path}x") == ["no description"]
    assert models.bundle_problems(spark, path, W.LABELS[::-1]) == ["other labels, or in another order"]
    good = json.loads((place / "about.json").read_text())
    (place / ".about.json.crc").unlink(missing_ok=True)
    for change, why in (({"status": "begun"}, "status begun"), ({"tuned_after_test": True}, "tuned_after_test is not false"), ({"digest": "0"}, "the weights are not"), ({"vocabulary_digest": "0"}, "the vocabulary is not"), ({"labels": ["A"]}, "as many classes")):
        (place / "about.json").write_text(json.dumps(good | change))
        (problem,) = models.bundle_problems(spark, path)
        assert why in problem
        with pytest.raises(ValueError, match=why):
            models.load(spark, path)
    (place / "about.json").write_text(json.dumps({k: v for k, v in good.items() if k != "versions"}))
    assert models.bundle_problems(spark, path) == ["the description lacks versions"]
    (place / "about.json").write_text(json.dumps(good | {"versions": {"numpy": "0.1"}}))
    models.load(spark, path)
    with pytest.raises(RuntimeError, match="numpy .*not 0.1"):
        models.load(spark, path, same_versions=True)


def test_versions():
    from sparrel.sources import sinks

    found = sinks.versions()
    sinks.require_versions(found | {"numpy": found["numpy"] + "+cpu"})
    major = found["pyspark"].split(".")[0]
    assert sinks.other_versions({"pyspark": major, "none": "1"}) == ["none none, not 1"]


def test_predictions_of_many_records_and_their_warning(spark):
    vocabulary = T.fit(spark.createDataFrame([(1, "brake disc"), (2, "oil filter")], "id int, t string"), "id", "t", 10)
    network = models.HeadNetwork("multimodal", 2, vocabulary.count(), 3, hidden=4)
    records = spark.createDataFrame([("a.png", "brake"), ("b.png", "unheard of")], "path string, description string")
    pictures = spark.createDataFrame([("a.png", [1.0, 0.0]), ("b.png", [0.0, 1.0])], "path string, features array<double>")
    rows = W.predict(records, pictures, vocabulary, network).collect()
    assert [(r.path, r.place) for r in rows] == [(p, k) for p in ("a.png", "b.png") for k in range(3)]
    assert all((r.warning is None) == (r.recognised > 0) == (r.path == "a.png") for r in rows)
    with pytest.raises(Exception, match="a description is required"):
        W.predict(records.withColumn("description", F.lit(" ")), pictures, vocabulary, network).collect()
