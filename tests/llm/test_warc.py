import hashlib

from sparrel.llm import common, warc

SCHEMA = "page_id bigint, url string, html string, digest string, payload string, key int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


ROWS = [
    (1, "http://a", "x" * 150), (2, "http://b", "x" * 150), (3, "http://c\r\nX-Evil: 1", "x" * 99), (4, "http://d", "x" * 99), (5, None, None), (6, "http://e", ""), (7, "http://f", "ü" * 50), (8, "http://g", "ü" * 50),
    (9, "http://h", "<p>lone</p>" * 40), (9, "http://h", "<p>lone</p>" * 40), (None, "http://i", "x" * 150),
]


def parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1"
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    assert end == b"\r\n\r\n"
    http, _, payload = block.partition(b"\r\n\r\n")
    assert http.startswith(b"HTTP/1.1 200 OK\r\n")
    return fields | {"payload": payload, "http": http}


def test_records_and_reconstruction(spark):
    path = common.shared_dir(spark, "test-warc")
    warc.write(pages(spark, ROWS), path)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()), key=repr)
    want = []
    for k, (page, _, html) in enumerate(ROWS):
        b = (html or "").encode()
        owners = [(p is None, p, j) for j, (p, _, h) in enumerate(ROWS) if (h or "").encode() == b]
        first = min(owners)
        own = len(b) < 100 or first[2] == k
        want.append((page, len(b), hashlib.sha256(b).hexdigest(), "response" if own else "revisit", None if own else first[1]))
    assert got == sorted(want, key=repr)

    stored = spark.read.parquet(f"{path}/payloads").collect()
    assert len(stored) == len({(h or "") for _, _, h in ROWS})
    found = warc.reconstruct(spark, path).collect()
    assert len(found) == len(ROWS)
    ids = set()
    for r in found:
        f = parse(bytes(r.record))
        ids.add(f["WARC-Record-ID"])
        assert "X-Evil" not in f
        if f["WARC-Type"] == "response":
            assert hashlib.sha256(f["payload"]).hexdigest() == f["WARC-Payload-Digest"].removeprefix("sha256:")
        else:
            assert f["payload"] == b"" and f["WARC-Refers-To"] != f["WARC-Record-ID"]
        assert hashlib.sha256(bytes(r.payload)).hexdigest() == f["WARC-Payload-Digest"].removeprefix("sha256:")
    assert len(ids) == len(ROWS)


def test_empty_table(spark):
    path = common.shared_dir(spark, "test-warc")
    warc.write(pages(spark, ROWS).where("false"), path)
    assert warc.read(spark, path).count() == 0 and warc.reconstruct(spark, path).count() == 0
