"""Paper metadata as a Spark data source: pages of works, read by executors, from a service or from where they were landed.

A page is the service's answer to one request, ``{"message": {"items": [...], "next-cursor": ...}}``. Landed pages lie as JSON lines, one page a line, in folders
``journal=<name>``. A service is asked for ``<url>/works?filter=...&rows=...&cursor=...``, page after page, until a page is short.

Filters on journal and year are the source's own: folders of other journals are not listed, a service gets them as part of the request, and rows are
checked in the reader. What cannot be read as a work comes back as a row with ``reject``, and its place, in the same result.
"""

from __future__ import annotations

import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from quern.sources import stores

SCHEMA = "doi string, title string, journal string, year int, lang string, reject string, page string, place int"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_ARROW = pa.schema([(n, pa.int32() if n in ("year", "place") else pa.string()) for n in _NAMES])
#: Works to a page of a service, and times that a page is asked for.
ROWS, TRIES = 1000, 4
#: Works given to Spark at once.
_BATCH = 5000


@dataclass
class Wanted:
    """What pushed filters ask for: journals (None: all), and years from and to."""

    journals: set[str] | None = None
    since: int | None = None
    until: int | None = None
    dated: bool = False

    def take(self, f: Filter) -> bool:
        """Whether a filter is taken over whole."""
        column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
        if column == "journal" and isinstance(f, (EqualTo, In)):
            names = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.journals = names if self.journals is None else self.journals & names
            return True
        if column == "year" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            self.dated = True
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                least = f.value + isinstance(f, GreaterThan)
                self.since = least if self.since is None else max(self.since, least)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                most = f.value - isinstance(f, LessThan)
                self.until = most if self.until is None else min(self.until, most)
            return True
        return False

    def keeps(self, journal: str | None, year: int | None) -> bool:
        if self.journals is not None and journal not in self.journals:
            return False
        if self.dated and year is None:
            return False
        return (self.since is None or year >= self.since) and (self.until is None or year <= self.until)


@dataclass
class Pages(InputPartition):
    """Pages that one task reads: a file of landed ones, or the pages of one request to a service."""

    address: str
    filters: dict = field(default_factory=dict)


def _first(x):
    return x[0] if isinstance(x, list) and x else None


def work(item) -> tuple[dict, str | None]:
    """An item's columns, or why it is no work. Fields of a wrong kind are null; a DOI that is missing or no text is a reason to reject."""
    if not isinstance(item, dict):
        return {}, "not an object"
    doi = item.get("DOI")
    if not isinstance(doi, str) or not doi.strip():
        return {}, "no DOI"
    published = item.get("published")
    year = _first(_first(published.get("date-parts"))) if isinstance(published, dict) else None
    text = lambda x: x if isinstance(x, str) else None
    year = year if isinstance(year, int) and not isinstance(year, bool) and abs(year) < 10_000 else None
    return {"doi": doi.strip().lower(), "title": text(_first(item.get("title"))), "journal": text(_first(item.get("container-title"))), "year": year, "lang": text(item.get("language"))}, None


def items_of(page: bytes | str) -> tuple[list, str | None, str | None]:
    """A page's items, the cursor of the next page, and why it is no page."""
    try:
        message = json.loads(page)["message"]
        items = message["items"]
    except (ValueError, KeyError, TypeError):
        return [], None, "not a page"
    return (items, message.get("next-cursor"), None) if isinstance(items, list) else ([], None, "not a page")


def landed_pages(address: str) -> Iterator[tuple[str, bytes]]:
    with stores.opened(address) as file:
        for k, line in enumerate(io.BufferedReader(file)):
            if line.strip():
                yield f"{address}#{k}", line


def fetched(url: str) -> bytes:
    """A request's answer, asked for again after errors that pass, a little later each time."""
    for k in range(TRIES):
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code not in (429, 500, 502, 503, 504) or k == TRIES - 1:
                raise
        except urllib.error.URLError:
            if k == TRIES - 1:
                raise
        time.sleep(0.2 * 2**k)
    raise AssertionError


def served_pages(url: str, filters: dict, rows: int) -> Iterator[tuple[str, bytes]]:
    cursor = "*"
    while cursor:
        asked = {"rows": rows, "cursor": cursor} | ({"filter": ",".join(f"{k}:{v}" for k, v in filters.items())} if filters else {})
        at = f"{url.rstrip('/')}/works?{urllib.parse.urlencode(asked)}"
        page = fetched(at)
        yield at, page
        items, following, _ = items_of(page)
        cursor = following if len(items) >= rows and following != cursor else None


class WorksReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.url, self.rows = options.get("path"), options.get("url"), int(options.get("rows", ROWS))
        self.journals = json.loads(options.get("journals", "null"))
        if (self.path is None) == (self.url is None):
            raise ValueError("one of path and url is needed")
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        """A partition for each landed file of a wanted journal; of a service, for each journal that is wanted or listed, or one for all."""
        wanted = self.wanted.journals
        if self.path is not None:
            out = []
            for name in stores.listed(self.path):
                folder = next((urllib.parse.unquote(x.removeprefix("journal=")) for x in name.split("/") if x.startswith("journal=")), None)
                if folder is None or wanted is None or folder in wanted:
                    out.append(Pages(f"{self.path.rstrip('/')}/{name}"))
            return out or [Pages("")]
        years = {k: f"{v:04d}" for k, v in (("from-pub-date", self.wanted.since), ("until-pub-date", self.wanted.until)) if v is not None}
        names = sorted(wanted) if wanted is not None else self.journals
        return [Pages(self.url, {"container-title": n} | years) for n in names] or [Pages("")] if names is not None else [Pages(self.url, years)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        if not partition.address:
            return
        pages = landed_pages(partition.address) if self.path is not None else served_pages(self.url, partition.filters, self.rows)
        held: list[dict] = []
        strict = self.wanted.journals is not None or self.wanted.dated  # a reject has no journal and no year, so a filter on them drops it
        for page, content in pages:
            items, _, reason = items_of(content)
            if reason and not strict:
                held.append({"reject": reason, "page": page})
            for place, item in enumerate(items):
                found, reason = work(item)
                if reason and not strict or not reason and self.wanted.keeps(found["journal"], found["year"]):
                    held.append(found | {"reject": reason, "page": page, "place": place})
                if len(held) >= _BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


class WorksSource(DataSource):
    """Options: ``path`` of landed pages, or ``url`` of a service, with ``rows`` to a page and ``journals`` (a JSON list), one task each."""

    @classmethod
    def name(cls) -> str:
        return "quern_works"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorksReader(self.options)


def works(spark: SparkSession, **options: str) -> DataFrame:
    """The source's rows. Filters on journal (equality, lists) and year (bounds) reach it; so do those of what is made of this frame later."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorksSource)
    return spark.read.format("quern_works").options(**options).load()


def land(works: DataFrame, path: str, rows: int = ROWS) -> None:
    """Lands works (doi, title, journal, year, lang) as pages under ``path``, a folder a journal: for data that did not come from a service.

    Works are dealt to as many pages as would hold all of them, by the DOI's hash, so that also a journal with most works has pages of about ``rows`` works.
    """
    dated = F.when(F.col("year").isNotNull(), F.struct(F.array(F.array("year")).alias("date-parts")))
    item = F.struct(F.col("doi").alias("DOI"), F.array("title").alias("title"), F.array("journal").alias("container-title"), dated.alias("published"), F.col("lang").alias("language"))
    page = F.pmod(F.xxhash64("doi"), F.lit(-(-works.count() // rows) or 1))
    grouped = works.groupBy("journal", page.alias("page")).agg(F.collect_list(item).alias("items"))
    grouped.select(F.to_json(F.struct(F.struct("items").alias("message"))).alias("value"), "journal").write.mode("append").partitionBy("journal").text(path)
