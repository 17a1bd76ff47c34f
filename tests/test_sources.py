"""The source of works, landed and served, and the message log."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from quern.sources import crossref, queue, stores
from quern.streaming import events


def item(k, journal="J", year=2020):
    return {"DOI": f"10.1/A{k}", "title": [f"T{k}", "x"], "container-title": [journal], "published": {"date-parts": [[year, 1]]}, "language": "zh"}


ODD = [{"title": ["no doi"]}, "text", None, {"DOI": 5}, {"DOI": " 10.1/B ", "title": [], "container-title": "J", "published": {"date-parts": [[None]]}}, item(9) | {"published": None, "language": 3}]


def test_works():
    assert [crossref.work(x)[1] for x in ODD] == ["no DOI", "not an object", "not an object", "no DOI", None, None]
    assert crossref.work(ODD[4])[0] == {"doi": "10.1/b", "title": None, "journal": None, "year": None, "lang": None}
    assert crossref.work(item(1))[0] == {"doi": "10.1/a1", "title": "T1", "journal": "J", "year": 2020, "lang": "zh"}
    assert [crossref.items_of(p)[2] for p in (b"{", b"[]", b'{"message": 1}', b'{"message": {"items": {}}}', b'{"message": {"items": []}}')] == ["not a page"] * 4 + [None]


def landed(tmp_path):
    pages = {"journal=J/a.txt": [[item(k, "J", 2000 + k) for k in range(8)], ODD], "journal=K%20L/a.txt": [[item(20, "K L", 2003)]], "journal=__HIVE_DEFAULT_PARTITION__/a.txt": [[item(30, None)]]}
    for name, lines in pages.items():
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text("\n".join(json.dumps({"message": {"items": x}}) for x in lines) + "\nbroken\n\n")
    (tmp_path / "_SUCCESS").write_text("")
    return f"file://{tmp_path}"


def test_landed_pages(spark, tmp_path):
    works = crossref.works(spark, path=landed(tmp_path))
    rows = works.collect()
    assert sorted(r.doi for r in rows if r.doi) == sorted([f"10.1/a{k}" for k in [*range(8), 9, 20, 30]] + ["10.1/b"])
    assert sorted((r.reject, r.place is None) for r in rows if r.reject) == [("no DOI", False)] * 2 + [("not a page", True)] * 3 + [("not an object", False)] * 2
    found = works.filter("journal = 'J' AND year > 2003 AND year <= 2006")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(f"Filter {x}" in plan or f"AND ({x}" in plan for x in ("(year", "(journal")), plan
    assert sorted(r.year for r in found.collect()) == [2004, 2005, 2006]
    assert works.filter("journal IN ('K L', 'x')").count() == 1 and works.filter("journal = 'x'").count() == 0
    assert works.filter("journal IS NULL AND reject IS NULL").count() == 2 and works.filter("year < 2002 OR lang = 'zh'").count() == 10


def test_pruned_partitions(tmp_path):
    reader = crossref.WorksReader({"path": landed(tmp_path)})
    filters = [In(("journal",), ("K L", "J")), EqualTo(("journal",), "K L"), GreaterThan(("year",), 2000), LessThanOrEqual(("year",), 2010), IsNotNull(("journal",)), EqualTo(("title",), "T")]
    assert list(reader.pushFilters(filters)) == filters[4:]
    assert [p.address.rpartition("/journal=")[2] for p in reader.partitions()] == ["K%20L/a.txt"]
    assert (reader.wanted.since, reader.wanted.until) == (2001, 2010)
    with pytest.raises(ValueError):
        crossref.WorksReader({})


class Service(BaseHTTPRequestHandler):
    """Pages of works by journal; every other request fails first."""

    asked: list = []

    def do_GET(self):  # noqa: N802
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        type(self).asked.append(q)
        if len(self.asked) % 2:
            self.send_error(503)
            return
        filters = dict(x.split(":") for x in q.get("filter", "").split(",") if x)
        found = [item(k, f"J{k % 3}", 2000 + k) for k in range(25) if filters.get("container-title") in (None, f"J{k % 3}") and 2000 + k >= int(filters.get("from-pub-date", 0))]
        at = 0 if q["cursor"] == "*" else int(q["cursor"])
        body = json.dumps({"message": {"items": found[at : at + int(q["rows"])], "next-cursor": str(at + int(q["rows"]))}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_service(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        works = crossref.works(spark, url=f"http://127.0.0.1:{server.server_port}", rows="4")
        assert sorted(r.doi for r in works.collect()) == sorted(f"10.1/a{k}" for k in range(25))
        Service.asked.clear()
        some = works.filter("journal IN ('J1', 'J2') AND year >= 2010")
        assert sorted(r.year for r in some.collect()) == [2000 + k for k in range(10, 25) if k % 3]
        assert {q["filter"] for q in Service.asked} == {f"container-title:J{k},from-pub-date:2010" for k in (1, 2)}
    finally:
        server.shutdown()


def test_service_gives_up(monkeypatch):
    monkeypatch.setattr(crossref.time, "sleep", lambda _: None)
    with pytest.raises(OSError):
        crossref.fetched("http://127.0.0.1:9/works")


def test_landing(spark, tmp_path):
    rows = [(f"10.1/{k}", "t" * k, [None, "a", "b/c"][k % 3], None if k % 5 == 0 else 2000 + k, "en") for k in range(40)]
    path = f"file://{tmp_path}/landed"
    crossref.land(spark.createDataFrame(rows, "doi string, title string, journal string, year int, lang string"), path, rows=10)
    got = crossref.works(spark, path=path)
    assert sorted(map(tuple, got.select("doi", "title", "journal", "year", "lang").collect()), key=str) == sorted(rows, key=str)
    assert got.filter("journal = 'b/c'").count() == sum(r[2] == "b/c" for r in rows)


def messages(spark, lo, hi):
    return spark.range(lo, hi, 1, 3).select(F.expr("if(id % 3 = 0, 'hot', cast(id % 11 as string))").alias("key"), F.col("id").cast("string").alias("value"), "id")


def test_offsets(spark, tmp_path):
    """Offsets of a partition have no gaps and follow the order; a key has one partition; a hot key's messages are many segments."""
    topic = f"file://{tmp_path}/topic"
    for lo, hi in ((0, 500), (500, 501), (501, 900)):
        queue.produce(messages(spark, lo, hi), topic, ["id"], partitions=4, segment=50)
    found = queue.segments(topic)
    assert sum(queue.ends(topic).values()) == 900 and max(map(len, found.values())) > 4
    for p, s in found.items():
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:]))
        rows = [r for part in queue.LogReader({"topic": topic}).partitions({}, {str(p): s[-1][1]}) for r in rows_of(topic, part)]
        assert [r[1] for r in rows] == list(range(len(rows)))
        assert all(int(a[3]) < int(b[3]) for a, b in zip(rows, rows[1:]))


def rows_of(topic, part):
    return [tuple(r.values()) for b in queue.LogReader({"topic": topic}).read(part) for r in b.to_pylist()]


def test_stopped_and_restarted(spark, tmp_path):
    """Every message once over triggers, stops and new messages; offsets are committed; a range can be read again with the same rows."""
    topic, folder = f"file://{tmp_path}/topic", f"file://{tmp_path}/out"
    for k in range(3):
        queue.produce(messages(spark, 100 * k, 100 * (k + 1)), topic, ["id"], partitions=3, segment=20)
        rows = events.continued(queue.stream(spark, topic), folder)
        assert sorted(int(r.value) for r in rows.collect()) == list(range(100 * (k + 1)))
        assert rows.select("partition", "offset").distinct().count() == 100 * (k + 1)
    events.continued(queue.stream(spark, topic), folder)  # nothing new
    assert rows.count() == 300
    done = queue.committed(topic)
    assert all(0 < done[p] <= n for p, n in queue.ends(topic).items())
    reader, p = queue.LogReader({"topic": topic}), max(queue.ends(topic), key=queue.ends(topic).get)
    parts = reader.partitions({str(p): 7}, {str(p): 31})
    again = [r for part in parts for r in rows_of(topic, part)]
    assert [r[1] for r in again] == list(range(7, 31)) and again == [r for part in parts for r in rows_of(topic, part)]
    dropped = queue.trim(topic, ["default"])
    assert dropped and queue.trim(topic, ["default", "never read"]) == []
    assert reader.initialOffset()[str(p)] == queue.segments(topic)[p][0][0] > 0
    with pytest.raises(ValueError, match="are gone"):
        reader.partitions({str(p): 0}, {str(p): 31})
    queue.produce(messages(spark, 300, 330), topic, ["id"], partitions=3, segment=20)
    assert sorted(int(r.value) for r in events.continued(queue.stream(spark, topic), folder).collect()) == list(range(330))


def test_no_messages(spark, tmp_path):
    topic = f"file://{tmp_path}/topic"
    assert queue.committed(topic) == {} and queue.ends(topic) == {} and stores.listed(topic) == []
    queue.produce(messages(spark, 0, 0), topic, ["id"])
    assert queue.ends(topic) == {}
