import hashlib
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from sparrel.sources import readers, sinks


def jpeg(width, height, parts=3):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * parts, 8, height, width, parts) + b"\0" * 3 * parts + b"\xff\xd9"


def png(width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_image_headers():
    assert readers.image_header(jpeg(224, 100)) == (224, 100, "RGB")
    assert readers.image_header(jpeg(9, 8, 1)) == (9, 8, "L") and readers.image_header(jpeg(9, 8, 4)) == (9, 8, "CMYK")
    assert readers.image_header(png(5, 6)) == (5, 6, "RGB") and readers.image_header(b"GIF89a") is None and readers.image_header(b"") is None


def test_archive_inspection(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("set/train/brake/1.JPG", jpeg(4, 3))
        z.writestr("set/test/brake/2.jpg", jpeg(4, 3))
        z.writestr("set/../evil.jpg", b"x")
        z.writestr("set/notes.txt", b"x")
        z.writestr("other/3.jpg", b"x")
    data = bytearray((tmp_path / "a.zip").read_bytes())
    at = data.index(jpeg(4, 3))
    data[at + 4] ^= 1  # the first member no longer fits its checksum
    (tmp_path / "a.zip").write_bytes(bytes(data))
    got = {r.path: r for r in readers.inspect_archive(readers.files(spark, str(tmp_path), "*.zip"), "set/").collect()}
    assert set(got) == {"set/train/brake/1.JPG", "set/test/brake/2.jpg", "set/../evil.jpg"}
    assert not got["set/train/brake/1.JPG"].crc_ok and got["set/test/brake/2.jpg"].crc_ok
    assert not got["set/../evil.jpg"].safe and (got["set/test/brake/2.jpg"].width, got["set/test/brake/2.jpg"].mode) == (4, "RGB")
    assert got["set/test/brake/2.jpg"].parts == ["set", "test", "brake", "2.jpg"]


def test_csv_reader_and_writer(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    sinks.write_csv(df, str(tmp_path / "out"), ["k"], single_file=True)
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes() == b"k,v\n1,a\n2,b\n"
    assert readers.csv(spark, str(tmp_path / "out"), ["k"]).count() == 2
    with pytest.raises(ValueError, match="missing columns: w"):
        readers.csv(spark, str(tmp_path / "out"), ["w"])
    with pytest.raises(AnalysisException):
        sinks.write_csv(df, str(tmp_path / "out"), ["k"])
    sinks.write_csv(df, str(tmp_path / "out"), ["k"], mode="overwrite")


def test_locked_split(spark, tmp_path):
    df = spark.createDataFrame([("1", "M", "train"), ("2", "M", "test")], "sample_id string, label string, split string")
    sinks.write_partitioned(df, str(tmp_path / "r"))
    assert [r.sample_id for r in readers.relations(spark, str(tmp_path / "r"), "train").collect()] == ["1"]
    with pytest.raises(PermissionError):
        readers.relations(spark, str(tmp_path / "r"), "test")
    assert readers.relations(spark, str(tmp_path / "r"), "test", allow_locked_test=True).count() == 1
    with pytest.raises(ValueError, match="unknown split"):
        readers.relations(spark, str(tmp_path / "r"), "dev")
    plan = readers.relations(spark, str(tmp_path / "r"), "train")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_documents_and_locks(tmp_path, spark):
    path = str(tmp_path / "d.json")
    sinks.write_json({"b": 1, "a": {"z": None}}, path)
    assert (tmp_path / "d.json").read_text() == '{\n  "a": {\n    "z": null\n  },\n  "b": 1\n}\n'
    with pytest.raises(FileExistsError):
        sinks.write_json({}, path)
    assert not sinks.write_if_changed({"a": {"z": None}, "b": 1}, path) and sinks.write_if_changed({"a": 2}, path)
    assert readers.json_documents(spark, path).first().a == 2
    lock = str(tmp_path / "lock.json")
    sinks.write_lock([path], lock, locked=True)
    assert sinks.verify_lock(lock, str(tmp_path), locked=True) == []
    sinks.write_if_changed({"a": 3}, path)
    assert sinks.verify_lock(lock, str(tmp_path), locked=False) == ["flag locked", "changed d.json"]
    (tmp_path / "d.json").unlink()
    assert sinks.verify_lock(lock, str(tmp_path), locked=True) == ["missing d.json"]
    assert json.dumps(sinks.lineage(spark, 44))


def test_state_digest_depends_on_everything():
    a = {"w": np.zeros((2, 3)), "b": np.ones(2)}
    digests = {sinks.state_digest(s) for s in (a, {"w": np.zeros((3, 2)), "b": np.ones(2)}, {"w": np.zeros((2, 3), np.float32), "b": np.ones(2)}, {"x": np.zeros((2, 3)), "b": np.ones(2)})}
    assert len(digests) == 4 and sinks.state_digest(dict(reversed(a.items()))) == sinks.state_digest(a)
    assert sinks.model_summary(a) == "b (2,) 2\nw (2, 3) 6\ntotal 8"


def test_hash_manifest(spark):
    lines = spark.createDataFrame([("ab  a b.txt",), ("",), ("cd  x  y",)], "value string")
    assert sorted(tuple(r) for r in readers.hash_manifest(lines).collect()) == [("ab", "a b.txt"), ("cd", "x  y")]


def test_category_index(spark):
    d = spark.createDataFrame([("b", "f"), ("a", "f")], "c string, f string")
    assert [(r.category, r["index"]) for r in readers.category_index(d, "c", "f", 2).orderBy("index").collect()] == [("a", 0), ("b", 1)]
    for bad, n in ((d, 3), (d.union(d), None)):
        with pytest.raises(ValueError, match="categories"):
            readers.category_index(bad, "c", "f", n)


def test_manifest_findings(spark):
    found = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2")], "category string, sha256 string")
    known = spark.createDataFrame([("1",)], "sha256 string")
    assert {r.check: r.value for r in readers.collect_manifest(found, 2, known).collect()} == {"category_size": 1, "repeated_content": 1, "known_content": 1}


def test_decoding_and_cached_features(spark, tmp_path):
    paths = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, path string")
    contents = spark.createDataFrame([("a", b"\1"), ("b", b"\2"), ("c", b"\3")], "path string, content binary")
    got = readers.decode_images(paths, contents, lambda b: [float(b[0])])
    assert sorted((r.k, r.features[0]) for r in got.collect()) == [(1, 1.0), (2, 1.0), (3, 2.0)]
    calls = []

    def build():
        calls.append(1)
        return paths.select("k", F.lit(1.0).alias("x"))

    for ids, n in ((paths, 1), (paths, 1), (paths.where("k < 3"), 2)):
        if n == 2:
            calls.clear(), calls.append(0)
        readers.cached_features(spark, str(tmp_path / "cache"), ids, "k", build)
        assert len(calls) == n


def test_single_record(spark):
    assert tuple(readers.single_record(spark, "/x/a.JPEG", " text ").first()) == ("/x/a.JPEG", "text")
    for path, text in (("/x/a.gif", "t"), ("/x/a.png", "  ")):
        with pytest.raises(ValueError, match="one of|description"):
            readers.single_record(spark, path, text)


def test_lazy_dataset_needs_known_categories(spark):
    r = spark.createDataFrame([("s", 1, "a", "b", "d", "MATCH")], "sample_id string, image_id int, part_category string, text_category string, description string, label string")
    f = spark.createDataFrame([(1, [0.5])], "image_id int, features array<double>")
    c = spark.createDataFrame([("a", 0), ("b", 1)], "category string, index int")
    got = readers.lazy_dataset(r, f, ["MATCH"], c).first()
    assert (got.label_code, got.image_code, got.text_code, got.features) == (0, 0, 1, [0.5])
    with pytest.raises(PySparkException, match="no features or codes"):
        readers.lazy_dataset(r, f, ["MATCH"], c.where("category = 'a'")).collect()


def test_zip_in_memory_is_read_like_a_file(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("p/1.jpg", png(2, 2))
    df = spark.createDataFrame([("m", buffer.getvalue())], "path string, content binary")
    assert readers.inspect_archive(df).first().width == 2



def test_copies_are_verified(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"x", hashlib.sha256(b"x").hexdigest()), ("b", b"y", "00")], "target string, content binary, sha256 string")
    assert sinks.copy_verified(rows.where("target = 'a'"), str(tmp_path / "good")).collect()[0].target == "a"
    with pytest.raises(Exception, match="not the bytes of b"):
        sinks.copy_verified(rows, str(tmp_path / "bad")).collect()
