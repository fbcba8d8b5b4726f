"""Trees, archives, the feature store, staged tables and charts."""

import hashlib
import json
import resource
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sparrel.operators.models import drawn
from sparrel.plans import workflows as W
from sparrel.sources import charts, features, files, images, readers, sinks, staged


def test_tree_lists_all_but_excluded_folders(spark, tmp_path):
    for name in ("a/x.pt", "a/.env", "a/b/c/deep.txt", ".git/x.pt", "a/__pycache__/y", "empty/.keep", "B.TMP", "a/Dataset_V2/z"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "hollow").mkdir()
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        found = {(r.path, r.folder, r["size"]) for r in files.tree(spark, root, (".git", "__pycache__")).collect()}
        want = {(str(p.relative_to(tmp_path)), p.is_dir(), None if p.is_dir() else p.stat().st_size) for p in tmp_path.rglob("*") if not {".git", "__pycache__"} & set(p.relative_to(tmp_path).parts)}
        assert found == want
    rules = {tuple(r) for r in files.forbidden_paths(spark, str(tmp_path), ["*.pt", "*.tmp", ".env"], ["dataset_v2"]).collect()}
    assert rules == {("a/x.pt", "*.pt"), ("a/.env", ".env"), ("a/Dataset_V2", "dataset_v2"), ("a/Dataset_V2/z", "dataset_v2")}
    assert files.tree(spark, str(tmp_path / "hollow")).collect() == []
    with pytest.raises(Exception, match="none"):
        files.tree(spark, str(tmp_path / "none"))


def test_files_against_their_manifest(spark, tmp_path):
    rows = [("d/a", b"x" * (3 << 20)), ("b", b""), ("c", None)]
    files.written(spark.createDataFrame(rows[:2], "path string, content binary"), str(tmp_path)).count()
    assert (tmp_path / "d/a").stat().st_size == 3 << 20
    digest = lambda b: hashlib.sha256(b or b"").hexdigest()
    manifest = spark.createDataFrame([(digest(b), p) for p, b in rows], "sha256 string, path string")
    assert [tuple(r) for r in files.verified(spark, manifest, str(tmp_path)).collect()] == [("c", "missing")]
    (tmp_path / "b").write_text("?")
    assert {tuple(r) for r in files.verified(spark, manifest, str(tmp_path)).collect()} == {("c", "missing"), ("b", "changed")}


def test_archive_members_by_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    picture = images.encode_png(rng.integers(0, 256, (4, 5, 3)))
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(40):
            z.writestr(f"set\\part/{k}.JPG", picture if k == 7 else rng.bytes(20_000))
        z.writestr("set/part/readme.txt", "no")
        z.writestr("other/9.jpg", "no")
        z.writestr("set/../../up.jpg", "unsafe")
        z.mkdir("set/folder.jpg")
    broken = (tmp_path / "a.zip").read_bytes().replace(b"unsafe", b"UNSAFE")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.zip").write_bytes(broken)
    (tmp_path / "no.zip").write_bytes(b"not an archive")
    df = files.archive_members(spark, str(tmp_path), "set/", task_bytes=100_000)
    assert df.rdd.getNumPartitions() > 10
    rows = df.collect()
    a = {r.path: r for r in rows if r.archive.endswith("a.zip")}
    assert len(a) == 41 and all(r.crc_ok for r in a.values()) and not a["set/../../up.jpg"].safe
    assert (a["set/part/7.JPG"].width, a["set/part/7.JPG"].height, a["set/part/7.JPG"]["mode"]) == (5, 4, "RGB")
    assert a["set/part/7.JPG"].sha256 == hashlib.sha256(picture).hexdigest() and a["set/part/3.JPG"].parts == ["set", "part", "3.JPG"]
    b = [r for r in rows if r.archive.endswith("b.zip")]
    assert len(b) == 41 and [r.path for r in b if not r.crc_ok] in ([], ["set/../../up.jpg"])
    assert [(r.path, r.crc_ok) for r in rows if r.archive.endswith("no.zip")] == [(None, False)]
    whole = files.archive_members(spark, str(tmp_path / "a.zip"), "set/part/7", content=True).first()
    assert whole.content == picture
    loaded = images.loaded(spark.createDataFrame([("p",)], "path string"), spark.createDataFrame([("p", bytes(whole.content))], "path string, content binary"), 2, 2)
    assert len(loaded.first().channels) == 3


def test_a_damaged_member_is_a_row(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("1.jpg", "good")
        z.writestr("2.jpg", "damaged")
    content = (tmp_path / "a.zip").read_bytes().replace(b"damaged", b"DAMAGED", 1)
    (tmp_path / "a.zip").write_bytes(content)
    rows = {r.path: (r.crc_ok, r.sha256) for r in files.archive_members(spark, str(tmp_path / "a.zip")).collect()}
    assert rows == {"1.jpg": (True, hashlib.sha256(b"good").hexdigest()), "2.jpg": (False, None)}


def test_an_archive_of_three_gigabytes(spark, tmp_path):
    """Stored members of zeros, 100 MB each, in a file with holes: larger than any value of a row may be."""
    size, zeros = 100 << 20, bytes(1 << 20)
    crc, h = 0, hashlib.sha256()
    for _ in range(100):
        crc = zlib.crc32(zeros, crc)
        h.update(zeros)
    path, entries = tmp_path / "large.zip", []
    with open(path, "wb") as f:
        for k in range(31):
            name, at = f"{k}.jpg".encode(), f.tell()
            f.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, 0, 0, 0, 0, crc, size, size, len(name), 0) + name)
            f.seek(size, 1)
            entries.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 20, 20, 0, 0, 0, 0, crc, size, size, len(name), 0, 0, 0, 0, 0, at) + name)
        start = f.tell()
        f.write(b"".join(entries) + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 31, 31, sum(map(len, entries)), start, 0))
    assert path.stat().st_size > 3 << 30
    df = files.archive_members(spark, str(path))

    def peak(rows):
        found = [(r.crc_ok, r.bytes, r.sha256) for r in rows]
        yield found, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss

    got = df.rdd.mapPartitions(peak).collect()
    assert df.rdd.getNumPartitions() == 31 and all(rows == [(True, size, h.hexdigest())] for rows, _ in got)
    assert max(kb for _, kb in got) < 600_000


def test_features_are_taken_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Counted(features.Convolution):
        def __call__(self, pictures):
            import uuid

            for _ in pictures:
                (calls / uuid.uuid4().hex).touch()
            return super().__call__(pictures)

    rng = np.random.default_rng(2)
    data = {k: rng.integers(0, 256, (3, 7, 9) if k % 2 else (3, 5, 5)) for k in range(10)}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in data.items()] + [(3, data[3].tolist())], "image_id int, channels array<array<array<int>>>")
    store, extractor = str(tmp_path / "store"), Counted(5)
    first = {r.image_id: r.features for r in features.kept(rows.where("image_id < 6"), "image_id", store, extractor).collect()}
    assert sorted(first) == list(range(6)) and len(list(calls.iterdir())) == 6
    both = {r.image_id: r.features for r in features.kept(rows, "image_id", store, extractor).collect()}
    assert sorted(both) == list(range(10)) and len(list(calls.iterdir())) == 10 and all(both[k] == first[k] for k in first)
    assert {r.image_id for r in features.kept(rows.where("image_id = 2"), "image_id", store, extractor).collect()} == {2} and len(list(calls.iterdir())) == 10
    features.kept(rows, "image_id", store, Counted(5, seed=45)).count()
    assert len(list(calls.iterdir())) == 20  # another extractor, other features
    assert features.kept(rows.limit(0), "image_id", str(tmp_path / "none"), extractor).collect() == []
    w = drawn(44, "filter", (27, 5)) / np.sqrt(27)
    for k, picture in data.items():
        p, out = picture / 255.0, []
        for y in range(0, p.shape[1] - 2, 2):
            for x in range(0, p.shape[2] - 2, 2):
                out.append(np.maximum(sum(p[c, y + a, x + b] * w[9 * c + 3 * a + b] for c in range(3) for a in range(3) for b in range(3)), 0))
        assert np.allclose(both[k], np.mean(out, axis=0))


class Stop(Exception):
    pass


def stages_of(spark, out, stop):
    """A run of three tables and a document that is stopped after some writes; the tables it wrote."""
    wrote = []
    s = staged.Staged(spark, out, {"of": 1})
    frames = {n: spark.range(k, k + 20).withColumn("g", F.col("id") % 2) for k, n in enumerate(("a", "b", "c"))}
    for k, (name, df) in enumerate(frames.items()):
        if k == stop:
            raise Stop
        s.table(name, df.withColumn("seen", F.col("id")), "g" if name == "b" else None)
        wrote.append(name)
    if stop == 3:
        raise Stop
    s.document("lock", {"rows": 20})
    if stop == 4:
        raise Stop
    s.publish()
    return wrote


@pytest.mark.parametrize("stop", range(5))
def test_a_stopped_run_publishes_nothing_and_goes_on(spark, tmp_path, stop, monkeypatch):
    out = f"file://{tmp_path}/out"
    with pytest.raises(Stop):
        stages_of(spark, out, stop)
    assert not (tmp_path / "out").exists()
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "out.unfinished").rglob("part-*") if "lock" not in str(p)}
    stages_of(spark, out, None)
    assert not (tmp_path / "out.unfinished").exists() and staged.checked(spark, out) == []
    for p, t in times.items():  # finished tables were not written again
        assert (tmp_path / "out" / p.relative_to(tmp_path / "out.unfinished")).stat().st_mtime_ns == t
    with pytest.raises(AnalysisException, match="EXISTS"):
        staged.Staged(spark, out, {"of": 1})


def test_an_unfinished_table_that_changed_is_written_again(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    with pytest.raises(Stop):
        stages_of(spark, out, 2)
    spark.range(3).withColumn("g", F.col("id")).withColumn("seen", F.col("id")).write.mode("overwrite").parquet(f"{out}.unfinished/a")
    stages_of(spark, out, None)
    assert spark.read.parquet(f"{out}/a").count() == 20 and staged.checked(spark, out) == []
    spark.range(3).write.mode("overwrite").parquet(f"{out}/c")
    assert staged.checked(spark, out) == ["c"]


def test_another_run_does_not_take_up_the_unfinished_one(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    with pytest.raises(Stop):
        stages_of(spark, out, 2)
    s = staged.Staged(spark, out, {"of": 2})
    assert s.done == {} and not (tmp_path / "out.unfinished/a").exists()


def test_a_stopped_build_is_resumed(spark, tmp_path, monkeypatch):
    rows = [(f"{c}{k}", c, c[0], f"{c}{k}") for c in ("a_x", "a_y", "b_x", "b_y") for k in range(10)]
    pictures = spark.createDataFrame(rows, "image_id string, category string, family string, sha256 string")
    templates, out = {s: (f"{s} a {{name}}", f"{s} b {{name}}") for s in readers.SPLITS}, str(tmp_path / "out")
    document = staged.Staged.document
    monkeypatch.setattr(staged.Staged, "document", lambda self, *a: (_ for _ in ()).throw(Stop()))
    with pytest.raises(Stop):
        W.build(spark, pictures, out, templates)
    assert not (tmp_path / "out").exists()
    monkeypatch.setattr(staged.Staged, "document", document)
    lock = W.build(spark, pictures, out, templates)
    assert W.read_document(spark, f"{out}/lock") == lock and staged.checked(spark, out) == []


def test_charts_hold_their_data_in_order(spark, tmp_path):
    points = spark.createDataFrame([("b", 0.5, 0.9), ("a", 0.7, 0.2), ("c", None, 0.9)], "m string, acc double, f1 double")
    chart = charts.bar(points, "m", ["acc", "f1"], "T")
    assert [(v["m"], v["series"], v["value"]) for v in chart["data"]["values"]] == [("a", "acc", 0.7), ("a", "f1", 0.2), ("b", "acc", 0.5), ("b", "f1", 0.9), ("c", "acc", None), ("c", "f1", 0.9)]
    path = f"file://{tmp_path}/c.json"
    charts.write(chart, path)
    assert json.loads(sinks.read_bytes(path)) == chart and charts.read(spark, path, "m string, series string, value double").count() == 6
    with pytest.raises(FileExistsError):
        charts.write(chart, path)
    cells = spark.createDataFrame([("x", "y", 3)], "t string, p string, n long")
    heat = charts.heat_map(cells, "t", "p", "n", ["x", "y"], "H")["data"]["values"]
    assert [(v["t"], v["p"], v["n"]) for v in heat] == [("x", "x", 0), ("x", "y", 3), ("y", "x", 0), ("y", "y", 0)]
    bins = charts.histogram(spark.createDataFrame([(0.0,), (1.0,), (9.9,), (10.0,), (None,), (float("nan"),)], "v double"), "v", 5, "B")["data"]["values"]
    assert [v["rows"] for v in bins] == [2, 0, 0, 0, 2] and bins[4]["end"] == 10.0
    assert charts.histogram(spark.createDataFrame([], "v double"), "v", 5, "B")["data"]["values"] == []
    assert sum(v["rows"] for v in charts.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 4, "B")["data"]["values"]) == 3
    with pytest.raises(ValueError, match="points"):
        charts.line(spark.range(6000).selectExpr("id x", "id y", "'s' s"), "x", "y", "s", "L")
