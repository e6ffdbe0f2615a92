"""List endpoints as a data source, and rows written to an endpoint.

``rest_list`` reads pages of JSON rows over HTTP in parallel, with an explicit schema; ``rest_rows`` makes a request of each
row. Register both with :func:`register`. Options of both: ``url``, ``token``, ``organisation``, ``timeout`` (seconds,
default 30), ``retries`` (default 4) and ``backoff`` (seconds before the first retry, doubled each time, default 0.5): a
connection that fails, an answer that a service gives when it is busy or broken (429 and 5xx), and nothing else, is tried
again; other answers but success are errors.

Reading: ``key`` (of the rows in the answer), ``total`` (key of the number of rows, default total), ``page`` (rows a page,
default 1000), ``filters`` (columns by which the endpoint filters, separated by commas; ``column=parameter`` where the
parameter has another name). Of a query's conditions those that a column of ``filters`` equals a value go to the endpoint;
Spark applies all of them to what comes back. Query parameters that hold always are part of the url. A page with another
number of rows than the total tells is an error, since the list has changed or a page was cut: no result is incomplete
without saying so.

Writing: ``method`` (default POST), ``key`` (the columns that tell rows apart, separated by commas), ``name`` of the
write (default: a new one each time). ``url`` may have ``{column}`` in it, whose value goes there; the other columns but
those of ``key`` are the body, nulls left out. Each request has an Idempotency-Key made of the write's name and the row's
key, so a service that knows it does once what a retried task asks for twice. Rows of one key are one request's worth: the
service does the first. With ``commit`` or ``abort``, urls, a request tells the service at the end how the write went.
"""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
import string
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage

#: Longest wait before a retry, in seconds, whatever the service asks for.
LONGEST_WAIT = 60.0


def request(options: dict[str, str], method: str, url: str, body: dict | None = None, headers: dict[str, str] | None = None):
    """The JSON answer to a request (null if it is empty), tried again while it fails as busy services and networks do."""
    sent = {"Accept": "application/json"} | (headers or {})
    if body is not None:
        sent["Content-Type"] = "application/json"
    if options.get("token"):
        sent["Authorization"] = f"Bearer {options['token']}"
    if options.get("organisation"):
        sent["X-Organization-ID"] = options["organisation"]
    data = None if body is None else json.dumps(body, default=_plain).encode("utf-8")
    tries, wait = int(options.get("retries", "4")), float(options.get("backoff", "0.5"))
    while True:
        asked = urllib.request.Request(url, data=data, headers=sent, method=method)
        try:
            with urllib.request.urlopen(asked, timeout=float(options.get("timeout", "30"))) as answer:
                text = answer.read()
                return json.loads(text) if text.strip() else None
        except urllib.error.HTTPError as error:
            if tries <= 0 or not (error.code == 429 or error.code >= 500):
                raise
            after = error.headers.get("Retry-After", "")
            pause = float(after) if after.isdigit() else wait
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if tries <= 0:
                raise
            pause = wait
        time.sleep(min(pause, LONGEST_WAIT))
        tries, wait = tries - 1, wait * 2


def _plain(value):
    """What JSON has no form for."""
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    raise TypeError(f"a column of type {type(value).__name__} can't be sent")


def fetch(options: dict[str, str], offset: int, limit: int, filters: dict[str, str] | None = None) -> dict:
    """One page of the rows that the endpoint's ``filters`` leave."""
    url = options["url"] + ("&" if "?" in options["url"] else "?") + urllib.parse.urlencode({**(filters or {}), "limit": limit, "offset": offset})
    return request(options, "GET", url) or {}


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        super().__init__(offset)
        self.offset, self.limit = offset, limit


class RestReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fields: list[tuple[str, str]]):
        self.options, self.fields = options, fields
        named = [f.strip().partition("=") for f in options.get("filters", "").split(",") if f.strip()]
        self.parameters = {column: parameter or column for column, _, parameter in named}
        self.filters: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equalities with a value that no missing one is read as; all are left to Spark too."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.parameters and isinstance(f.value, (str, int)) and not isinstance(f.value, bool) and f.value:
                self.filters.setdefault(self.parameters[f.attribute[0]], str(f.value))
            yield f

    def partitions(self) -> list[InputPartition]:
        """A partition a page; the endpoint says how many rows there are."""
        page, name = int(self.options.get("page", "1000")), self.options.get("total", "total")
        total = fetch(self.options, 0, 1, self.filters).get(name)
        if not isinstance(total, int):
            raise ValueError(f"the answer doesn't tell the number of rows as {name!r}")
        return [Page(i, min(page, total - i)) for i in range(0, total, page)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.limit:
            return
        empty = {"string": "", "int": 0, "bigint": 0, "double": 0.0}
        rows = fetch(self.options, partition.offset, partition.limit, self.filters).get(self.options["key"]) or []
        if len(rows) != partition.limit:
            raise ValueError(f"{len(rows)} rows at {partition.offset} where there should be {partition.limit}: the list changed, or the page was cut; a smaller page may help")
        for row in rows:
            yield tuple(row.get(name) if row.get(name) is not None else empty.get(kind) for name, kind in self.fields)


class RestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_list"

    def schema(self) -> str:
        raise ValueError("give a schema; none is inferred")

    def reader(self, schema) -> RestReader:
        return RestReader(dict(self.options), [(f.name, f.dataType.simpleString()) for f in schema.fields])


@dataclass
class Written(WriterCommitMessage):
    rows: int


class RestWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.options = {"name": uuid.uuid4().hex} | options
        self.key = [c.strip() for c in options.get("key", "").split(",") if c.strip()]
        self.in_url = [name for _, name, _, _ in string.Formatter().parse(options["url"]) if name]
        unknown = {*self.key, *self.in_url} - {*columns}
        if not self.key or unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}" if unknown else "give the columns that tell rows apart as key")

    def write(self, iterator) -> Written:
        n, options = 0, self.options
        for row in iterator:
            row = row.asDict(recursive=True)
            if any(row[c] is None for c in [*self.key, *self.in_url]):
                raise ValueError("a column of the key or the url is null")
            url = options["url"].format(**{c: urllib.parse.quote(str(row[c]), safe="") for c in self.in_url})
            key = json.dumps([options["name"], *(row[c] for c in self.key)], default=_plain)
            body = {c: v for c, v in row.items() if v is not None and c not in self.in_url and c not in self.key}
            request(options, options.get("method", "POST"), url, body, {"Idempotency-Key": hashlib.sha256(key.encode("utf-8")).hexdigest()})
            n += 1
        return Written(n)

    def _tell(self, option: str, messages: list[Written | None]) -> None:
        if self.options.get(option):
            done = [m for m in messages if m is not None]
            request(self.options, "POST", self.options[option], {"name": self.options["name"], "rows": sum(m.rows for m in done), "tasks": len(done)}, {"Idempotency-Key": f"{self.options['name']}-{option}"})

    def commit(self, messages: list[Written | None]) -> None:
        self._tell("commit", messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What was written stays: written again under the same name, it is known to the service."""
        self._tell("abort", messages)


class RestSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_rows"

    def writer(self, schema, overwrite: bool) -> RestWriter:
        if overwrite:
            raise ValueError("rows are appended; nothing is overwritten")
        return RestWriter(dict(self.options), [f.name for f in schema.fields])


def register(spark: SparkSession) -> None:
    """Makes ``rest_list`` and ``rest_rows`` known to the session, and lets filters reach the endpoint."""
    spark.dataSource.register(RestSource)
    spark.dataSource.register(RestSink)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def send(rows: DataFrame, url: str, key: str, method: str = "POST", **options: str) -> None:
    """Writes ``rows`` to the endpoint; other options as in the module's description."""
    register(rows.sparkSession)
    rows.write.format("rest_rows").options(url=url, key=key, method=method, **options).mode("append").save()
