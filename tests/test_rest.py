import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from faultline.operators import risks
from faultline.sources import rest

ROWS = [{"id": f"r{i}", "score": i, "extra": 1, "status": ("detected", "resolved")[i % 3 == 0]} | ({"title": "t"} if i % 2 else {}) for i in range(25)]


class Service(ThreadingHTTPServer):
    """A list, and a log of writes that does what has the same key once."""

    daemon_threads = True

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.asked, self.written, self.keys, self.calls = [], [], {}, Counter()
        self.broken, self.cut, self.refused, self.lock = 0, False, set(), threading.Lock()
        self.url = f"http://127.0.0.1:{self.server_port}"


class Handler(BaseHTTPRequestHandler):
    def answer(self, status, body=None, **headers):
        self.send_response(status)
        for name, value in headers.items():
            self.send_header(name.replace("_", "-"), value)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode() if body is not None else b"")

    def do_GET(self):
        service, q = self.server, parse_qs(urlparse(self.path).query)
        with service.lock:
            service.asked.append(q)
            service.broken, broken = service.broken - 1, service.broken > 0
        if broken:
            return self.answer(503)
        if self.headers.get("Authorization") != "Bearer k":
            return self.answer(401)
        low, n = int(q["offset"][0]), int(q["limit"][0])
        rows = [r for r in ROWS if all(r.get(c) == q[c][0] for c in ("status", "title") if c in q)]
        found = rows[low : low + n]
        return self.answer(200, {"risks": found[:-1] if service.cut and len(found) > 1 else found, "total": len(rows)})

    def do_POST(self):
        service, key = self.server, self.headers["Idempotency-Key"]
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with service.lock:
            service.calls[self.path] += 1
            if self.path in service.refused:
                service.refused.discard(self.path)
                return self.answer(400)
            service.broken, broken = service.broken - 1, service.broken > 0
            if key not in service.keys:
                service.keys[key] = self.path
                service.written.append((self.command, self.path, body))
        # Done, but the answer is lost: the row is asked for again.
        return self.answer(429, Retry_After="0") if broken else self.answer(200, {})

    do_PATCH = do_POST

    def log_message(self, *a):
        pass


@pytest.fixture
def service():
    server = Service()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def listed(spark, service, **options):
    rest.register(spark)
    read = spark.read.format("rest_list").schema("id string, title string, score int, status string").options(url=f"{service.url}/risks?all=1", key="risks", token="k", page="10", backoff="0.01")
    return read.options(**options).load()


def test_pages(spark, service):
    df = listed(spark, service)
    rows = sorted(df.collect(), key=lambda r: r.score)
    assert [r.id for r in rows] == [r["id"] for r in ROWS] and [r.title for r in rows[:2]] == ["", "t"] and df.rdd.getNumPartitions() == 3
    assert all(q["all"] == ["1"] for q in service.asked)


def test_filters_reach_the_endpoint(spark, service):
    df = listed(spark, service, filters="status, name=title").filter("status = 'resolved' and score > 5")
    assert sorted(r.score for r in df.collect()) == [6, 9, 12, 15, 18, 21, 24]
    assert service.asked and all(q["status"] == ["resolved"] and "score" not in q for q in service.asked)
    # A column that the endpoint has no filter for, an alternative, and a value that missing ones are read as stay with Spark.
    for condition in ("title = 't'", "status = 'resolved' or score = 1", "status = ''"):
        service.asked.clear()
        got = sorted(r.id for r in listed(spark, service, filters="status").filter(condition).collect())
        assert got == sorted(r.id for r in listed(spark, service).filter(condition).collect())
        assert all("status" not in q and "title" not in q for q in service.asked)


def test_a_filter_that_finds_nothing(spark, service):
    assert listed(spark, service, filters="status").filter("status = 'other'").count() == 0


def test_busy_service_is_asked_again(spark, service):
    service.broken = 3
    assert listed(spark, service).count() == 25 and len(service.asked) > 4
    service.broken = 100
    with pytest.raises(PySparkException, match="503"):
        listed(spark, service, retries="1").count()


def test_refusal_is_not_tried_again(spark, service):
    with pytest.raises(PySparkException, match="401"):
        listed(spark, service, token="wrong").count()
    assert len(service.asked) == 1


def test_short_pages_and_lists_without_total(spark, service):
    service.cut = True
    with pytest.raises(PySparkException, match="where there should be 10"):
        listed(spark, service).collect()
    with pytest.raises(PySparkException, match="number of rows"):
        listed(spark, service, total="count").collect()


REGISTER = "id long, risk_code string, status string"


def test_each_row_is_written_once(spark, service):
    """Answers that are lost and a write that stops half-way and is done again under its name."""
    df = spark.createDataFrame([(i, f"R-{i}", "detected") for i in range(40)], REGISTER)
    codes = df.filter("id % 2 = 0").select("risk_code").union(df.limit(3).select("risk_code"))
    asked = risks.status_requests(df, codes, "accepted", "known").repartition(3)
    service.broken, service.refused = 4, {"/risks/24/status"}
    url, options = f"{service.url}/risks/{{id}}/status", {"backoff": "0.01", "name": "one", "commit": f"{service.url}/commit", "abort": f"{service.url}/abort"}
    with pytest.raises(PySparkException, match="400"):
        rest.send(asked, url, "id", "PATCH", **options)
    assert [w[1] for w in service.written if w[1] in ("/abort", "/commit")] == ["/abort"]
    rest.send(asked, url, "id", "PATCH", **options)
    done = [w for w in service.written if w[1].startswith("/risks")]
    wanted = {i for i in range(40) if i % 2 == 0 or i < 3}
    assert sorted(done, key=repr) == sorted((("PATCH", f"/risks/{i}/status", {"status": "accepted", "reason": "known"}) for i in wanted), key=repr)
    assert sum(service.calls.values()) > len(service.written)
    assert service.written[-1] == ("POST", "/commit", {"name": "one", "rows": asked.count(), "tasks": 3})


def test_resolving_sends_the_reason_alone(spark, service):
    df = spark.createDataFrame([(1, "R-1", "detected"), (2, "R-2", "detected")], REGISTER)
    rest.send(risks.status_requests(df, df.filter("id = 2").select("risk_code"), "resolved"), f"{service.url}/risks/{{id}}/resolve", "id")
    assert service.written == [("POST", "/risks/2/resolve", {"reason": "Resolved"})]
    # Another write of the same row is another request.
    rest.send(risks.status_requests(df, df.filter("id = 2").select("risk_code"), "resolved"), f"{service.url}/risks/{{id}}/resolve", "id")
    assert len(service.written) == 2


def test_evidence_is_submitted(spark, service):
    rows = spark.createDataFrame([(7, "test", "a b/c", None), (8, "code", "ü", "f00")], "control_id long, type string, name string, git_hash string").withColumn("key", F.col("control_id")).withColumn("at", F.lit("2024-01-02").cast("date"))
    rest.send(rows, f"{service.url}/evidence/{{name}}", "key")
    assert sorted(service.written, key=repr) == [
        ("POST", "/evidence/%C3%BC", {"control_id": 8, "type": "code", "git_hash": "f00", "at": "2024-01-02"}),
        ("POST", "/evidence/a%20b%2Fc", {"control_id": 7, "type": "test", "at": "2024-01-02"}),
    ]
    for wrong in ({"key": ""}, {"key": "other"}):
        with pytest.raises(Exception, match="tell rows apart|no such columns"):
            rest.send(rows, f"{service.url}/e", wrong["key"])
