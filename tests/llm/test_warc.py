import base64
import gzip
import hashlib
import io

import pytest

from eventrate.llm import warc

FOLDER = "/root/testdata/sf0.001"
DATE = "2024-01-01T00:00:00Z"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def fields(block):
    return [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if x]


@pytest.fixture(scope="module")
def responses(spark):
    return warc.responses(spark.read.parquet(f"{FOLDER}/pages.parquet"), DATE)


def test_pages(spark, responses):
    stored = {r.record_id: r for r in responses.collect()}
    made = warc.derivatives(responses).collect()
    assert len(made) == 2 * len(stored) and len({r.record_id for r in made}) == len(made)
    by = {(r.headers["WARC-Refers-To"], r.type): r for r in made}
    for record_id, source in stored.items():
        payload = source.block.split(b"\r\n\r\n", 1)[1]
        assert source.headers["WARC-Payload-Digest"] == sha1(payload)
        meta, text = by[(record_id, "metadata")], by[(record_id, "conversion")]
        told = fields(meta.block)
        assert dict(told)["conversion"] == text.record_id
        assert dict(told)["source-payload-digest"] == sha1(payload) and dict(told)["digest-check"] == "match"
        assert dict(told)["source-block-digest"] == sha1(source.block)
        assert [v for k, v in told if k == "source-header"] == source.block.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:]
        assert payload.decode().count('href="') == sum(k == "outlink" for k, _ in told)
        for r in (meta, text):
            assert r.headers["WARC-Block-Digest"] == sha1(r.block)
            assert r.headers["WARC-Refers-To-Target-URI"] == source.target_uri == r.target_uri
            assert r.headers["WARC-Refers-To-Date"] == DATE
        assert b"<p>" not in text.block and b"track(" not in text.block


def test_files_round_trip(spark, responses, tmp_path):
    every = responses.unionByName(warc.derivatives(responses))
    folder = str(tmp_path / "archive")
    warc.write_warc(every, folder)

    def plain(df):
        return sorted((r.record_id, r.type, r.target_uri, r.date, sorted((r.headers or {}).items()), bytes(r.block)) for r in df.collect())

    assert plain(warc.read_warc(spark, folder)) == plain(every)


def test_foreign_files():
    one = warc.record_bytes("<urn:uuid:1>", "response", "http://a/", DATE, [("X-A", "1"), ("X-A", "2")], b"HTTP/1.1 200 OK\r\n\r\nbody")
    two = warc.record_bytes("<urn:uuid:2>", "warcinfo", None, None, [], b"x" * 3_000_000 + b"\r\n\r\nWARC/1.1")
    for raw in (one + two, gzip.compress(one) + gzip.compress(two), gzip.compress(one + two)):
        got = list(warc.read_records(io.BytesIO(raw)))
        assert [r["record_id"] for r in got] == ["<urn:uuid:1>", "<urn:uuid:2>"]
        assert got[0]["headers"] == [("X-A", "1, 2")] and got[1]["block"].endswith(b"WARC/1.1")
    assert [r["record_id"] for r in warc.read_records(io.BytesIO((one + two)[:-50]))] == ["<urn:uuid:1>"]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"no archive\r\n\r\n")))


def test_edges(spark):
    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: %s\r\n\r\n"
    rows = [
        ("<a>", "response", "u", DATE, {"WARC-Payload-Digest": "sha1:WRONG"}, http % b"text/html; charset=iso-8859-1" + b"<p>caf\xe9</p>"),
        ("<a>", "response", "u", DATE, {"WARC-Payload-Digest": "sha1:WRONG"}, http % b"text/html; charset=iso-8859-1" + b"<p>caf\xe9</p>"),
        (None, "response", None, None, None, None), ("<b>", "request", "u", DATE, {}, b"GET"),
        ("<c>", "response", "u", DATE, {}, http % b"image/png" + bytes(range(256))),
        ("<d>", "response", "u", DATE, {}, http % b"text/plain; charset=nonsense" + b"a <p> b"),
        ("<e>", "response", "u", DATE, {}, b"<p>no header</p>" + b"long " * 100_000),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], warc.SCHEMA + ", text int")
    got = warc.derivatives(df).collect()
    assert len(got) == 12
    texts = {r.headers.get("WARC-Refers-To"): bytes(r.block).decode() for r in got if r.type == "conversion"}
    assert texts["<a>"] == "café" and texts[None] == "" and texts["<c>"] == "" and texts["<d>"] == "a <p> b"
    assert texts["<e>"].startswith("no header\nlong long")
    first = [bytes(r.block).decode() for r in got if r.type == "metadata" and r.headers.get("WARC-Refers-To") == "<a>"]
    assert first[0] == first[1] and "digest-check: mismatch" in first[0] and "status-line: HTTP/1.1 404" in first[0]
    assert warc.derivatives(df.limit(0)).collect() == []
