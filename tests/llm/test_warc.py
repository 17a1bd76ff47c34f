import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import warc


def record(i, block, compress=True):
    return warc.encode([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:page:{i}>")], block, compress)


BLOCKS = [b"", b"plain", b"WARC/1.1\r\nnot a record\r\n\r\n", b"\x1f\x8b\x08 looks like a member", bytes(range(256)) * 40]


def parts(data):
    found = list(warc.salvage(data))
    return [r.block for r in found if isinstance(r, warc.Record)], [g for g in found if isinstance(g, tuple)]


@pytest.mark.parametrize("compress", [True, False])
def test_intact(compress):
    assert parts(b"".join(record(i, b, compress) for i, b in enumerate(BLOCKS))) == (BLOCKS, [])
    assert parts(b"") == ([], [])


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("harm", ["flip", "cut", "insert", "head", "tail"])
def test_later_records_are_recovered(compress, harm):
    records = [record(i, f"block {i} ".encode() * 50, compress) for i in range(5)]
    start, end = sum(map(len, records[:2])), sum(map(len, records[:3]))
    data, middle = b"".join(records), (start + end) // 2
    if harm == "flip":
        data = data[:middle] + bytes([data[middle] ^ 0x55]) + data[middle + 1 :]
        gap = (start, end)
    elif harm == "cut":
        data, gap = data[:middle] + data[end:], (start, middle)
    elif harm == "insert":
        data, gap = data[:start] + b"rubbish" + data[start:], (start, start + 7)
    elif harm == "head":
        data, gap = b"xx" + data, (0, 2)
    else:
        data, gap = data[:-3], (sum(map(len, records[:4])), len(data) - 3)
    lost = {"flip": [2], "cut": [2], "tail": [4]}.get(harm, [])
    blocks, gaps = parts(data)
    assert blocks == [f"block {i} ".encode() * 50 for i in range(5) if i not in lost]
    assert gaps == [gap]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 4), st.booleans())
def test_rubbish_between_records(rubbish, at, compress):
    records = [record(i, b"b%d" % i, compress) for i in range(4)]
    blocks, gaps = parts(b"".join([*records[:at], rubbish, *records[at:]]))
    assert blocks == [b"b0", b"b1", b"b2", b"b3"]
    assert gaps == ([(sum(map(len, records[:at])), sum(map(len, records[:at])) + len(rubbish))] if rubbish else [])


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 3])
def test_pages(spark, least):
    rows = [(5, "u", "<p>é</p>"), (2, "u\r\nx: y", "<p>é</p>"), (9, None, None), (8, "e", ""), (7, "t", "ab"), (6, "t", "ab"), (10, "long", "x" * 300_000), (None, None, "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 AS payload", "7 AS sha1")
    folder = warc.shared_dir(spark, "warc-test")
    warc.write(pages.repartition(3), folder, least)
    found = {r.page_id: r for r in warc.read(spark, folder).collect()}
    assert len(found) == len(rows)
    for page_id, _, html in rows:
        payload, r = (html or "").encode(), found[page_id]
        same = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        revisit = len(payload) >= least and page_id != min(same)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), b32(html), "revisit" if revisit else "response", min(same) if revisit else None)
        assert r.payload is None if revisit else bytes(r.payload) == payload
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_harmed_files_are_logged(spark, tmp_path):
    data = b"".join(record(i, b"block %d" % i) for i in range(3))
    (tmp_path / "a.warc.gz").write_bytes(b"??" + data)
    (tmp_path / "b.warc.gz").write_bytes(b"nothing at all")
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted((r.file, r.gap_start, r.gap_end) for r in rows if r.gap_start is not None) == [("a.warc.gz", 0, 2), ("b.warc.gz", 0, 14)]
    assert sorted(r.page_id for r in rows if r.page_id is not None) == [0, 1, 2]


def test_repeated_rows_and_null_ids(spark):
    """One response per payload: other copies of its row revisit it, also where no row has an id."""
    rows = [(5, "u", "same"), (5, "u", "same"), (5, "v", "same"), (7, "u", "same"), (None, "u", "same"), (None, "a", "none"), (None, "a", "none"), (None, None, "none")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = sorted(((r.page_id, r.url, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    want = [(5, "u", "response", None), (5, "u", "revisit", 5), (5, "v", "revisit", 5), (7, "u", "revisit", 5), (None, "u", "revisit", 5)]
    want += [(None, "a", "response", None), (None, "a", "revisit", None), (None, None, "revisit", None)]
    assert got == sorted(want, key=str)
    folder = warc.shared_dir(spark, "warc-test")
    warc.write(pages, folder, 100)
    found = warc.read(spark, folder).collect()
    assert len(found) == len(rows) and all(r.record_type == "response" and r.payload is not None for r in found)


def test_a_common_row_is_spread(spark):
    """A third of all rows are one row, another third share its payload."""
    pages = spark.range(30_000).selectExpr("if(id % 3 = 0, 1, id) AS page_id", "'u' AS url", "if(id % 3 < 2, 'common', concat('own', id)) AS html")
    got = {(r.record_type, r.refers_to): r.n for r in warc.round_trip(pages).groupBy("record_type", "refers_to").agg(F.count("*").alias("n")).collect()}
    assert got == {("response", None): 10_001, ("revisit", 1): 19_999}


@pytest.mark.parametrize("compress", [True, False])
def test_payloads_have_to_agree(compress):
    head = b"HTTP/1.1 200 OK\r\n\r\n"

    def response(stated, length, body=b"body", head=head):
        return warc.encode([("WARC-Type", "response"), ("WARC-Payload-Digest", stated), ("WARC-Payload-Length", length)], head + body, compress)

    sha = hashlib.sha1(b"body")
    good = [response(f"sha1:{b32('body')}", "4"), response(f"sha1:{sha.hexdigest()}", "4"), response("md5:zz", "4")]
    good.append(response("sha1:other", "4", head=b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"))
    bad = [response(f"sha1:{b32('other')}", "4"), response(f"sha1:{b32('body')}", "999")]
    blocks, gaps = parts(b"".join([good[0], bad[0], good[1], bad[1], *good[2:]]))
    assert len(blocks) == 4
    at = len(good[0])
    assert gaps == [(at, at + len(bad[0])), (at + len(bad[0]) + len(good[1]), at + len(bad[0]) + len(good[1]) + len(bad[1]))]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("harm", ["flip", "head"])
def test_much_damage_takes_time_in_proportion(compress, harm):
    """An archive of 32 MB, half of whose records are damaged."""
    import random
    import time

    rng = random.Random(1)
    one = [record(i, rng.randbytes(280), compress) for i in range(500)]
    if harm == "flip":
        worse = [r[: len(r) // 2] + bytes([r[len(r) // 2] ^ 0x55]) + r[len(r) // 2 + 1 :] for r in one]
    else:
        worse = [r[:12] for r in one]  # the beginnings of members and of version lines, and nothing else
    block = b"".join(x for pair in zip(one, worse) for x in pair)
    times = (32 << 20) // len(block)
    began = time.perf_counter()
    found = list(warc.salvage(block * times))
    assert sum(isinstance(r, warc.Record) for r in found) == 500 * times
    assert sum(isinstance(r, tuple) for r in found) == 500 * times
    assert time.perf_counter() - began < 60


def test_archives_are_read_in_blocks(monkeypatch):
    """The same records and gaps, whatever is read at once."""
    records = [record(i, bytes([i]) * 3000, i % 2 == 0) for i in range(12)]
    data = b"".join([*records[:3], b"rubbish", *records[3:8], records[8][:100], *records[9:]])
    want = parts(data)
    assert len(want[0]) == 11 and len(want[1]) == 2
    for size in (1, 7, 64, 5000):
        monkeypatch.setattr(warc.Source, "BLOCK", size)
        assert parts(data) == want


def test_gaps_fail_the_query(spark, monkeypatch):
    from quern.llm import queries
    from tests.conftest import DATA

    put = warc.put
    monkeypatch.setattr(warc, "put", lambda folder, name, content: put(folder, name, content[:-5]))
    assert warc.round_trip(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")).filter("gap_start IS NOT NULL").count() == 1
    monkeypatch.setattr(queries.warc, "round_trip", lambda pages: pages.selectExpr("page_id", "0L AS payload_bytes", "'' AS payload_digest", "'' AS record_type", "0L AS refers_to", "'f' AS file", "1L AS gap_start"))
    with pytest.raises(Exception, match="damaged archive f"):
        queries.op4_warc(spark, f"{DATA}/sf0.001").collect()
