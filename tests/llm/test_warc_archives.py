"""Archives that others wrote: any record type, with and without compression, without an index, and cut into ranges."""

import gzip
import random

import pytest

from chronolith.llm import warc


def made(kind, n, block, **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{n}>", "Content-Length": str(len(block)), **{k.replace("_", "-"): v for k, v in more.items()}}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


@pytest.fixture(scope="module")
def records():
    r = random.Random(81)
    page = r.randbytes(30_000) + b"\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n\x1f\x8b\x08"
    http = {"Content_Type": "application/http; msgtype=response"}
    return [
        made("warcinfo", 0, b"software: x\r\n", Content_Type="application/warc-fields"),
        made("request", 1, b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request", WARC_Target_URI="http://a/"),
        made("response", 2, b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + page, WARC_Target_URI="<http://a/%C3%A4>", **http),
        made("revisit", 3, b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<urn:uuid:2>", WARC_Payload_Digest="sha1:ABC", **http),
        made("metadata", 4, b"", Content_Type="application/warc-fields"),
        made("resource", 5, b"\r\n\r\nplain\r\n", Content_Type="text/plain"),
        *(made("response", i, b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nbody%05d" % i, WARC_Target_URI=f"http://b/{i}", **http) for i in range(10, 400)),
    ]


def contents(spark, path, **options):
    rows = warc.read_warc(spark, f"file://{path}", **options).collect()
    assert len({x.record_id for x in rows}) == len(rows)
    return {x.record_id[10:-1]: (x.record_type, x.page_id, x.target_uri, x.refers_to, x.payload_bytes, None if x.payload is None else bytes(x.payload)) for x in rows}


@pytest.mark.parametrize("form", ["plain", "members", "whole"])
@pytest.mark.parametrize("size", [32 << 20, 1500])
def test_other_archives(spark, tmp_path, records, form, size):
    at = tmp_path / "deep"
    at.mkdir()
    file = at / ("x.warc" if form == "plain" else "x.warc.gz")
    file.write_bytes({"plain": b"".join(records), "members": b"".join(map(gzip.compress, records)), "whole": gzip.compress(b"".join(records))}[form])
    (at / "notes.txt").write_text("no archive")
    got = contents(spark, tmp_path, range_bytes=size)  # found below the folder
    assert got == contents(spark, file) and len(got) == len(records)
    assert got["0"] == ("warcinfo", None, None, None, 13, b"software: x\r\n")
    assert got["1"][:3] == ("request", None, "http://a/") and got["1"][5].startswith(b"GET")
    assert got["2"][2] == "http://a/ä" and got["2"][5].endswith(b"\x1f\x8b\x08") and got["2"][4] == len(got["2"][5]) > 30_000
    assert got["3"] == ("revisit", None, None, "<urn:uuid:2>", None, None)
    assert got["4"][4:] == (0, b"") and got["5"][5] == b"\r\n\r\nplain\r\n"
    assert all(got[str(i)][5] == b"body%05d" % i for i in range(10, 400))
    back = warc.read_warc(spark, f"file://{tmp_path}", payload=False, range_bytes=size)
    some = back.filter("record_type in ('request', 'revisit') or record_id = '<urn:uuid:50>'").collect()
    assert {x.record_type for x in some} == {"request", "revisit", "response"} and all(x.payload is None for x in some)
    assert [x.target_uri for x in back.filter("target_uri = 'http://b/77'").collect()] == ["http://b/77"]
    assert back.filter("record_type = 'response'").count() == 391


@pytest.mark.parametrize("index", [True, False])
def test_own_archives_in_ranges_with_and_without_an_index(spark, tmp_path, index):
    r = random.Random(82)
    rows = [(i, f"http://{i}", r.randbytes(r.randrange(2000)).hex() if i % 4 else "same") for i in range(120)]
    warc.pages_to_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), f"file://{tmp_path}")
    if not index:
        for x in tmp_path.glob("*.idx"):
            x.rename(x.with_suffix(".gone"))
    back = warc.read_warc(spark, f"file://{tmp_path}", range_bytes=3000)
    assert back.rdd.getNumPartitions() > 10
    got = {int(x.page_id): (x.record_type, x.refers_to, x.payload_bytes, None if x.payload is None else bytes(x.payload).decode()) for x in back.collect()}
    assert got == {i: ("revisit", "0", 4, None) if i and i % 4 == 0 else ("response", None, len(h), h) for i, _, h in rows}
    assert back.filter("record_type = 'revisit'").count() == 29
    assert [x.page_id for x in warc.read_warc(spark, f"file://{tmp_path}", False).filter("page_id = '5'").collect()] == ["5"]


def test_least_payload_for_revisits(spark, tmp_path):
    rows = [(1, "u", "short"), (2, "u", "short"), (3, "u", "x" * 50), (4, "u", "x" * 50)]
    got = {x.page_id: (x.record_type, x.refers_to) for x in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), 6).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_broken_archives_fail(spark, tmp_path, records):
    whole = b"".join(map(gzip.compress, records[:3]))
    for name, data in (("a", whole[:-100]), ("b", b"WARC/1.0\r\nWARC-Type: x\r\n"), ("c", b"".join(records[:3])[:-500])):
        file = tmp_path / f"{name}.warc{'.gz' if name == 'a' else ''}"
        file.write_bytes(data)
        with pytest.raises(Exception, match="ends inside a record|without the end"):
            warc.read_warc(spark, f"file://{file}").collect()
