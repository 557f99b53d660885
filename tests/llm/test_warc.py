"""WARC: round trips, the member and index layout, revisits, edge cases."""

import base64
import gzip
import hashlib
import zlib

import pytest
from helpers import SF

from blendwise.llm import warc
from blendwise.session import scratch_path


def round_trip(spark, pages, least=0):
    folder = scratch_path(spark, "warc-test")
    archives = warc.write_monolithic(warc.with_revisits(pages, "page_id", "url", "html", least), folder)
    normal = warc.normalise(archives)
    return archives, normal, warc.read_archives(normal).collect()


def want_of(rows, least=0):
    best = {}
    for page_id, html in rows:
        data = (html or "").encode()
        if len(data) >= least and (best.get(data) is None or (page_id is not None and page_id > best[data])):
            best[data] = page_id
    return best


def test_query_on_a_table(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = warc.op5_warc(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        data = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        largest = max(k for k, v in pages.items() if v == data)
        assert (r.record_type, r.refers_to) == (("response", None) if largest == r.page_id else ("revisit", largest))


@pytest.mark.parametrize("limit", [0, 100_000])
def test_copies_nulls_and_extra_columns(spark, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
    rows = [(None, None, None), (3, "a b\r\nx", ""), (3, "u", ""), (5, None, "é"), (7, "z", "é"), (5, None, "é"), (9, "u", "x\r\n\r\ny" * 1000),
            (-4, "u", "x\r\n\r\ny" * 1000), (11, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "page_id bigint, url string, html string, payload int, id int, key string")
    _, _, got = round_trip(spark, pages)
    best = want_of([(r[0], r[2]) for r in rows])
    assert len(got) == len(rows)
    text = {base64.b32encode(hashlib.sha1((r[2] or "").encode()).digest()).decode(): (r[2] or "").encode() for r in rows}
    for r in got:
        data = text[r.payload_digest]
        first = r.id is not None and r.id == best[data]
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", best[data]))
        assert r.payload_bytes == len(data) and (r.payload is None if not first else bytes(r.payload) == data)


def test_smaller_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    _, _, got = round_trip(spark, pages, least=3)
    assert {(r.id, r.record_type, r.refers_to) for r in got} == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)}


def test_members_and_index(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * i) for i in range(50)], "page_id bigint, url string, html string")
    archives, normal, _ = round_trip(spark, pages)
    local = lambda uri: uri.removeprefix("file://")
    whole = b"".join(gzip.decompress(open(local(r.archive), "rb").read()) for r in archives.orderBy("archive").collect())
    again = b""
    for r in normal.orderBy("archive").collect():
        data = open(local(r.archive), "rb").read()
        end = 0
        for line in open(local(r["index"])).read().splitlines():
            rid, kind, offset, length = line.split("\t")
            assert int(offset) == end and kind == "response"
            end += int(length)
            one = zlib.decompressobj(31)
            rec = one.decompress(data[int(offset):end])
            assert one.eof and not one.unused_data and rid.encode() in rec
        assert end == len(data) == r.bytes
        again += gzip.decompress(data)
    assert again == whole


def test_inflating_by_chunks_and_cut_archives():
    import io

    recs = [warc.record(i, "http://x", b"p" * i, warc.payload_digest(b"p" * i)) for i in range(0, 3000, 250)]
    mono = gzip.compress(b"".join(recs))
    mixed = gzip.compress(b"".join(recs[:5])) + gzip.compress(b"".join(recs[5:]))
    for data in (mono, mixed):
        for size in (1, 7, 100_000):
            assert list(warc.records_of(warc.inflated(io.BytesIO(data), size))) == recs
    with pytest.raises(ValueError):
        list(warc.records_of([b"".join(recs)[:-5]]))


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert round_trip(spark, pages)[2] == []
