import gzip
import hashlib
import io
import itertools
import json
import random
import tarfile
import tracemalloc

import pytest
from pyspark.sql import functions as F

from faultline.operators import controls, discovery, editors, graph, hazard, ingest, integrity, knowledge, risks
from faultline.plans import catalogue
from faultline.plans.relations import Relations
from faultline.schemas import SCHEMAS, empty
from faultline.sources import documents, scratch, sinks
from faultline.streaming import incidents

RISKS = "id long, risk_code string, title string, category string, score int, status string, linked_services array<string>"


@pytest.fixture(scope="module")
def register(spark):
    rows = [(1, "R-1", "a", "c1", 90, "detected", ["p/x"]), (2, "R-2", "b", "c1", 90, "detected", []), (3, "R-3", "c", "c2", 50, "resolved", ["p/x"]), (4, "R-4", "d", "c2", 10, "detected", None)]
    return spark.createDataFrame(rows, RISKS)


def codes(df):
    return [r.risk_code for r in df.collect()]


def test_ready_ties_by_id(register):
    assert codes(risks.ready(register, limit=2)) == ["R-1", "R-2"]
    assert [r.rank for r in risks.ready(register, limit=0).collect()] == [1, 2, 3]
    assert risks.remaining(register, 1).first().asDict() == {"total_open": 3, "remaining": 2}


def test_filters(register):
    assert sorted(codes(risks.list_risks(register, service="p/x"))) == ["R-1", "R-3"]
    assert sorted(codes(risks.list_risks(register, status="detected", category="c2"))) == ["R-4"]
    assert risks.list_risks(register).count() == 4


def test_status_changes(spark, register):
    hit = spark.createDataFrame([("R-1",), ("R-1",), ("R-9",)], "risk_code string")
    rows = {r.risk_code: r for r in risks.with_status(register, hit, "resolved").collect()}
    assert len(rows) == 4 and rows["R-1"].status == "resolved" and rows["R-1"].status_reason == "Resolved" and rows["R-2"].status == "detected"


def test_empty_tables(spark):
    none = spark.createDataFrame([], RISKS)
    assert risks.ready(none).count() == 0 and risks.priority_summary(none).count() == 0 and risks.remaining(none).first().total_open == 0


def test_stpa_structured_first(spark):
    rows = [("t", "", None, "**Loss Scenario:** x"), ("", "", None, "**Loss Scenario:** x")]
    df = spark.createDataFrame(rows, "uca_type string, loss_scenario string, causal_factors array<string>, narrative string")
    a, b = [r.stpa for r in risks.stpa_view(df, parse=True).collect()]
    assert a.uca_type == "t" and b.loss_scenario == "x"


def test_control_codes(spark):
    with pytest.raises(ValueError):
        controls.by_code(spark.createDataFrame([("RC-1",)], "control_code string"), "R-1")


def test_evidence_gaps_and_submissions(spark):
    control = spark.createDataFrame([(1, "RC-1", ["test", "code"]), (2, "RC-2", [])], "id int, control_code string, expected_evidence_types array<string>")
    evidence = spark.createDataFrame([(1, "test", "n")], "control_id int, type string, name string")
    assert [tuple(r) for r in controls.evidence_gaps(control, evidence).collect()] == [("RC-1", "code")]
    new = spark.createDataFrame([(2, "code", "m"), (2, "", "bad")], "control_id int, type string, name string")
    rows = controls.submit_evidence(evidence, new, "abc").collect()
    assert len(rows) == 2 and rows[1].git_hash == "abc" and rows[1].status == "configured"
    assert [r.expected for r in controls.expected_type(control, spark.createDataFrame([("RC-1", "test"), ("RC-9", "test")], "control_code string, type string")).orderBy("control_code").collect()] == [True, False]


def test_procedure_fallback(spark):
    df = spark.createDataFrame([("a", ["RC-1"]), ("b", ["RC-2"]), ("c", None)], "id string, related_controls array<string>")
    assert [r.id for r in knowledge.procedures_for_control(df, "RC-1").collect()] == ["a"]
    assert knowledge.procedures_for_control(df, "RC-9").count() == 3


def test_causal_chain_order(spark):
    df = spark.createDataFrame([([(2, "b", ""), (1, "a", "")],)], "causal_chain array<struct<order:int,event:string,typical_delay:string>>")
    assert [x.event for x in knowledge.causal_chains(df).first().causal_chain] == ["a", "b"]


def test_search_ties_and_zero_vectors(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id int, query_vector array<double>")
    many = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    whole = sorted(map(tuple, knowledge.semantic_search(v, many, 2).collect()))
    monkeypatch.setattr(knowledge, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, knowledge.semantic_search(v, many, 2).collect())) == whole and len(whole) == 8
    assert [(r.rank, r.vec_id) for r in knowledge.semantic_search(v, q, 3).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 4)]


EDGES = "source_type string, source_id string, target_type string, target_id string, relation_type string, strength double, direction string"


def test_graph(spark):
    rows = [("n", "a", "n", "b", "causes", 0.5, ""), ("n", "b", "n", "c", "causes", 0.5, ""), ("n", "c", "n", "a", "causes", 0.5, ""), ("n", "a", "n", "d", "causes", 0.2, ""), ("n", "e", "n", "a", "causes", 0.3, "bidirectional")]
    edges = spark.createDataFrame(rows, EDGES)
    assert {(r.entity_id, r.depth) for r in graph.traverse(edges, "a").collect()} == {("b", 1), ("e", 1), ("c", 2)}
    paths = {tuple(r.path): round(r.total_strength, 4) for r in graph.foresight(edges, "a").collect()}
    assert paths == {("a", "b"): 0.5, ("a", "e"): 0.3, ("a", "b", "c"): 0.25}
    assert graph.traverse(edges, "a", relation_types="other, none").count() == 0
    assert graph.relationships(edges, "a").count() == 4


def all_strongest(edges, seed, depth, k):
    """Every simple path, in order."""
    found, level = [], [((seed,), 1.0)]
    for n in range(1, depth + 1):
        level = [((*path, dst), total * s) for path, total in level for src, dst, s in edges if src == path[-1] and dst not in path]
        found += [(-total, n, path) for path, total in level]
    return [(seed, i, path, n, -total) for i, (total, n, path) in enumerate(sorted(found)[:k], 1)]


def test_strongest_paths(spark, monkeypatch):
    """Cycles, hubs, parallel edges and ties: the first k of the list of all paths, whatever k."""
    rng = random.Random(8)
    nodes = [f"n{i}" for i in range(9)]
    plain = [(a, b, rng.choice([0.25, 0.5, 0.5, 0.75, 1.0])) for a in nodes for b in nodes if a != b and rng.random() < 0.5]
    plain += plain[:6] + [("n0", f"leaf{i}", 0.5) for i in range(30)]
    edges = spark.createDataFrame([("n", a, "n", b, "causes", s, "") for a, b, s in plain], EDGES)
    seeds = spark.createDataFrame([("n0",), ("n3",), ("n3",), ("leaf1",), ("none",), (None,)], "entity_id string")
    for k, depth, hot in ((1, 3, 100), (4, 4, 2), (60, 3, 5), (100_000, 3, 100)):
        monkeypatch.setattr(graph, "HOT_EDGES", hot)
        got = sorted((r.seed, r["rank"], tuple(r.path), r.depth, r.total_strength) for r in graph.strongest_paths(edges, seeds, k, depth, min_strength=0.0).collect())
        assert got == sorted(all_strongest(plain, "n0", depth, k) + all_strongest(plain, "n3", depth, k))
    with pytest.raises(ValueError):
        graph.strongest_paths(edges.withColumn("strength", F.col("strength") * 3), seeds, 1)


def test_strongest_paths_move_few_edges(spark, monkeypatch):
    """Edges are read once, whatever the depth, and no edge is moved but those of the nodes that paths go on from."""
    rows = [("n", "a", "n", f"b{i}", "causes", 0.9, "") for i in range(3)] + [("n", f"b{i}", "n", f"c{i}", "causes", 0.8, "") for i in range(3)] + [("n", f"x{i}", "n", f"y{i}", "causes", 0.7, "") for i in range(500)]
    seeds, edges, read, moved = spark.createDataFrame([("a",)], "entity_id string"), spark.createDataFrame(rows, EDGES), [], []
    usable, ways = graph.usable, graph._strongest_links
    monkeypatch.setattr(graph, "usable", lambda *a: read.append(1) or usable(*a))
    monkeypatch.setattr(graph, "_strongest_links", lambda links, *a: moved.append(links.count()) or ways(links, *a))
    for broadcast in (1000, 0):
        monkeypatch.setattr(graph, "BROADCAST_ROWS", broadcast)
        got = graph.strongest_paths(edges, seeds, 10)
        assert [len(r.path) for r in got.orderBy("rank").collect()] == [2, 2, 2, 3, 3, 3]
    assert len(read) == 2 and moved == [3, 3, 0] * 2
    read.clear()
    catalogue.queries()["foresight_strongest"](spark, "/root/testdata/sf0.001")
    assert len(read) == 1


def test_edges_stay_in_their_buckets(spark, monkeypatch):
    """A level moves its frontier, not the edges; a source with very many edges has several buckets."""
    rows = [("n", f"a{i % 40}", "n", f"a{i * 7 % 41}", "causes", 0.5 + i % 3 / 10, "") for i in range(300)] + [("n", "a1", "n", f"b{i}", "causes", 0.9, "") for i in range(50)]
    edges = spark.createDataFrame(rows, EDGES)
    plain = sorted(map(repr, graph.traverse(edges, "a1").collect()))
    monkeypatch.setattr(graph, "HOT_EDGES", 10)
    assert sorted(map(repr, graph.traverse(edges, "a1").collect())) == plain
    links, hot = graph._adjacency(graph.usable(edges))
    frontier = spark.createDataFrame([("a1", "x"), ("a2", "y")], "src string, seed string")
    level = graph._followed(links, hot, frontier)
    plan = level._jdf.queryExecution().executedPlan().toString()
    assert hot is not None and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert level.count() == sum(r[1] in ("a1", "a2") for r in rows)


def test_hierarchy_of_any_depth(spark):
    """Chains deeper than any number of rounds that is fixed, a cycle and what leads into it, a parent that is not there."""
    rows = [(i, i - 1 if i else None) for i in range(1000)] + [(2000, 2002), (2001, 2000), (2002, 2001), (2003, 2002), (2004, 2004), (3000, 9999), (3001, 3000), (3001, None), (None, 1)]
    up = hazard.hierarchy(spark.createDataFrame(rows, "scenario_id long, parent_id long"))
    got = {r.scenario_id: (r.root_id, r.depth) for r in up.collect()}
    assert got == {**{i: (0, i) for i in range(1000)}, **{i: (None, None) for i in (2000, 2001, 2002, 2003, 2004)}, 3000: (3000, 0), 3001: (3000, 1)}
    assert "Join" not in up._jdf.queryExecution().optimizedPlan().toString()
    assert hazard.hierarchy(spark.createDataFrame([], "scenario_id long, parent_id long")).count() == 0


def test_longest_prefix_of_many_lengths(spark):
    """200 different lengths, names within names, and paths that leave them at every place."""
    rng = random.Random(3)
    text = "".join(rng.choice("ab/") for _ in range(260))
    names = [(f"c{n}", text[:n]) for n in rng.sample(range(1, 260), 200)] + [(f"d{i}", "".join(rng.choice("ab") for _ in range(rng.randint(1, 8)))) for i in range(60)] + [("e", ""), ("a0", text[:50]), ("z0", text[:50])]
    paths = [text[:n] + rng.choice(["", "x", "a", "b/a"]) for n in range(260)] + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(200)] + ["", "q", text[:3], text[:3]]
    components = spark.createDataFrame(names, "name string, path string")
    got = sorted((r.path, r.component) for r in ingest.longest_prefix(spark.createDataFrame([(p,) for p in paths], "path string"), components).collect() if r.component)
    best = lambda p: min(((-len(x), n) for n, x in names if x and p.startswith(x)), default=(0, None))[1]
    assert got == sorted((p, best(p)) for p in paths if best(p))
    lengths = sorted({len(x) for _, x in names if x})
    assert all(len(x) <= len(lengths).bit_length() for x in ingest._search_order(lengths).values())
    short = [(n, x) for n, x in names if len(x) < 4]
    best = lambda p: min(((-len(x), n) for n, x in short if x and p.startswith(x)), default=(0, None))[1]
    got = ingest.longest_prefix(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(short, "name string, path string"))
    assert sorted((r.path, r.component) for r in got.collect() if r.component) == sorted((p, best(p)) for p in paths if best(p))
    none = ingest.longest_prefix(spark.createDataFrame([("a",)], "path string"), components.limit(0))
    assert [tuple(r) for r in none.collect()] == [("a", None)]
    assert ingest.longest_prefix(spark.createDataFrame([("a",), (None,)], "path string"), components).count() == 2


def test_files_are_read_once(spark, tmp_path):
    """One scan of the files for all rules, and a pattern with more matches than any rank holds keeps its place."""
    rows = [("r", f"p/d{i}/x.txt", None) for i in range(300)] + [("r", "package.json", json.dumps({"workspaces": ["p/*", "q", "p/d1"]})), ("r", "q/a", None), ("r", "settings.gradle.kts", "include 'q'"), ("r", "settings.gradle", "include 'p:d2'")]
    spark.createDataFrame(rows, "repo string, path string, content string").write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    plan = discovery.facts(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    found = {r.path: (r.name, r.phase) for r in discovery.components(files).collect()}
    assert found == {**{f"p/d{i}/": (f"d{i}", 12) for i in range(300)}, "q/": ("q", 12)}


def test_upsert(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, graph.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert graph.delete(old, "k", "a").count() == 1


def test_longest_prefix(spark):
    paths = spark.createDataFrame([("services/ab/x",), ("other",), (None,), ("services/a",)], "path string")
    comps = spark.createDataFrame([("a", "services/a"), ("all", "services/"), ("ab", "services/ab/"), ("b2", "services/ab/")], "name string, path string")
    assert {r.path: r.component for r in ingest.longest_prefix(paths, comps).collect()} == {"services/ab/x": "ab", "other": None, None: None, "services/a": "a"}


def test_linked_services_precedence(spark):
    rows = [(1, ["given"], "c", ["a/x"]), (2, [], "c", ["a/x"]), (3, None, "", ["a/x", "b/y"]), (4, [], None, ["zzz"]), (5, None, None, None)]
    df = spark.createDataFrame(rows, "finding_id int, linked_services array<string>, component string, evidence_paths array<string>")
    comps = spark.createDataFrame([("A", "a/"), ("B", "b/")], "name string, path string")
    got = {r.finding_id: r.linked_services for r in ingest.linked_services(df, comps, "p").collect()}
    assert got == {1: ["given"], 2: ["p/c"], 3: ["p/A", "p/B"], 4: [], 5: None}


def test_findings_of_either_root(spark):
    rows = [(1, '{"findings":[{"a":1},{"a":2}]}'), (2, '[{"a":3}]'), (3, "not json"), (4, '{"other":1}'), (5, None)]
    df = spark.createDataFrame(rows, "id int, value string")
    got = ingest.findings(df).select("id", "pos", F.try_variant_get("finding", "$.a", "int").alias("a")).orderBy("id", "pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, 1), (1, 1, 2), (2, 0, 3)]
    assert ingest.submission_fields(spark.createDataFrame([(1, '{"service":"","business_criticality":0}')], "id int, value string"), service="s").first().asDict() == {"id": 1, "service": "s", "scan_type": "full", "scan_mode": None, "business_criticality": None}


def test_gates(spark):
    row = spark.range(1).select(
        ingest.ci_status(F.lit(0), F.lit(1)).alias("ci"),
        ingest.ci_status(F.lit(0), F.lit(0), F.lit(True)).alias("failed"),
        ingest.review_status(F.lit("warn"), F.lit(True), F.lit(True), F.lit(True), F.lit(True)).alias("warn"),
        ingest.review_label(F.lit("warn")).alias("label"),
        ingest.without_flag(F.array(F.lit("a"), F.lit("--x"), F.lit("--x")), "--x").alias("flag"),
    ).first()
    assert (row.ci, row.failed, row.warn, row.label, row.flag.arguments, row.flag.present) == (1, 2, 0, "HOLD", ["a"], True)


HAZARD = {
    "losses": [{"title": "Data loss"}, {"title": "NEW"}, {"title": "new"}],
    "findings": [{"content": "x", "control_code": ""}, {"content": "y", "control_code": "RC-1"}],
    "loss_scenarios": [
        {"title": "leaf", "level": "immediate", "parent_title": "root", "uca_refs": [0, 7], "control_links": [{"control_code": "RC-1", "relationship": "mitigates"}, {"control_code": "RC-9", "relationship": "x"}]},
        {"title": "root", "level": "top", "parent_title": "leaf", "uca_refs": [1]},
    ],
    "control_structure": {"nodes": [{"node_key": "n"}], "edges": [{"from_key": "n", "to_key": "m"}]},
}


def test_hazard_document(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps(HAZARD))
    document = documents.hazard_document(spark, str(tmp_path / "h.json"))
    out = hazard.submit(document, spark.createDataFrame([("data LOSS",)], "title string"), spark.createDataFrame([(5, "RC-1")], "id int, control_code string"), repo_url="r")
    assert sorted(r.title for r in out["losses"].collect()) == ["NEW", "new"]
    assert [r.control_code for r in out["ucas"].orderBy("pos").collect()] == [None, "RC-1"]
    parents = {r.title: r.parent_id for r in out["scenarios"].collect()}
    assert parents == {"leaf": "scenario-1", "root": None}
    assert out["uca_links"].count() == 2 and [tuple(r) for r in out["missing_refs"].collect()] == [("scenario-0", 7)]
    assert [r.control_id for r in out["control_links"].collect()] == [5] and out["nodes"].count() == 1
    tree = hazard.hierarchy(out["scenarios"].select("scenario_id", "parent_id"))
    assert {r.scenario_id: (r.root_id, r.depth) for r in tree.collect()} == {"scenario-0": ("scenario-1", 1), "scenario-1": ("scenario-1", 0)}


def test_integrity(spark, tmp_path):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, content in (("a", b"1"), ("b", b"2"), ("c", b"3"), (integrity.MANIFEST, b"{}")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    (tmp_path / "x.tar.gz").write_bytes(gzip.compress(raw.getvalue()))
    files = documents.archive_members(spark, str(tmp_path / "x.tar.gz"))
    hashes = integrity.hashed(files)
    good = {r.path: r.hash for r in hashes.collect()}
    manifest = spark.createDataFrame([("a", good["a"]), ("b", "sha256:no"), ("z", "sha256:no")], "path string, hash string")
    got = {r.path: r.outcome for r in integrity.reconcile(manifest, hashes).collect()}
    assert got == {"a": "ok", "b": "mismatch", "c": "untracked", "z": "missing"}
    assert integrity.canonical_input(manifest).first().canonical == f"a:{good['a']}\nb:sha256:no\nz:sha256:no\n"
    signed = spark.createDataFrame([("x", "00", "RSA")], "canonical string, signature string, algorithm string")
    assert integrity.verify_signature(signed, b"0" * 32).first().verified is False


def test_keyed_table_in_buckets(spark, tmp_path, monkeypatch):
    """Only what changes is written, and a crash leaves the old table or the new one."""
    path, schema = str(tmp_path / "t"), "k int, `a b` string"
    rows = lambda: sorted(map(tuple, sinks.read_keyed(spark, path, schema).collect()))
    frame = lambda own: spark.createDataFrame(own, schema)
    stamps = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    assert rows() == []
    sinks.upsert_keyed(frame([(i, "old") for i in range(200)]), path, ["k"], 16)
    before, known = stamps(), {i: "old" for i in range(200)}
    assert rows() == sorted(known.items()) and len(before) == 16
    sinks.upsert_keyed(frame([(7, "x"), (7, "new"), (500, "new")]).coalesce(1), path, ["k"], 16)
    known |= {7: "new", 500: "new"}
    assert rows() == sorted(known.items())
    after = stamps()
    assert sum(after.get(f) == t for f, t in before.items()) >= 14
    sinks.delete_keyed(spark.createDataFrame([(500,), (8,), (999,)], "k int"), path, schema, 16)
    del known[500], known[8]
    assert rows() == sorted(known.items())
    # Stopped before all is written: nothing has changed. Stopped after that: the change holds.
    with monkeypatch.context() as m:
        m.setattr(sinks, "_renamed", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            sinks.upsert_keyed(frame([(1, "lost")]), path, ["k"], 16)
    assert rows() == sorted(known.items())
    done, real = [], sinks._renamed

    def twice(*a):
        if len(done) == 3:
            raise OSError("stopped")
        done.append(real(*a))

    with monkeypatch.context() as m:
        m.setattr(sinks, "_renamed", twice)
        with pytest.raises(OSError):
            sinks.upsert_keyed(frame([(i, "kept") for i in range(40)]), path, ["k"], 16)
    known |= {i: "kept" for i in range(40)}
    assert rows() == sorted(known.items()) and not [f for f in tmp_path.iterdir() if f.name != "t"]
    sinks.delete_keyed(sinks.read_keyed(spark, path, schema).select("k"), path, schema, 16)
    assert rows() == []


def tarred(files):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, content in files:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return raw.getvalue()


def test_archives_are_streamed(spark, tmp_path):
    """Long members come in pieces, and nothing larger than a piece and a line is held."""
    line = b"0123456789" * 20 + b"\n"
    long, odd = line * 400_000, bytes(range(256)) * 300 + b"\n\n\r\n"
    (tmp_path / "x.tar.gz").write_bytes(gzip.compress(tarred([("./long", long), ("empty", b""), ("odd", odd)]), 1))
    (tmp_path / "y.tar.gz").write_bytes(gzip.compress(tarred([("only", odd), ("only", b"again")])))
    (tmp_path / "z.tar.gz").write_bytes(gzip.compress(tarred([("a", b"x" * 5000)])[:2000]))
    pieces = documents.archive_members(spark, str(tmp_path), piece=1 << 20).select("archive", "path", "number", F.length("content").alias("n")).collect()
    own = sorted((r.number, r.n) for r in pieces if r.path == "long")
    assert [n for n, _ in own] == [*range(len(own))] and sum(n for _, n in own) == len(long) and max(n for _, n in own) == 1 << 20
    got = {(r.archive[-8:-7], r.path): (r["size"], r.hash) for r in documents.archive_hashes(spark, str(tmp_path)).collect()}
    digest = lambda x: (len(x), "sha256:" + hashlib.sha256(x).hexdigest())
    assert got[("x", "long")] == digest(long) and got[("x", "odd")] == digest(odd) and got[("x", "empty")] == digest(b"") and got[("y", "only")] == digest(b"again") and ("z", None) in got
    # Lines are made as they are asked for: 400 MB go through without being there.
    head = tarred([("long", b"")])[:512]
    info = tarfile.TarInfo("long")
    info.size = len(line) * 2_000_000
    lines = itertools.chain([("t", info.tobuf() + line[:-1])], (("t", line[:-1]) for _ in range(1_999_999)), [("t", bytes(1 << 14))])
    tracemalloc.start()
    assert head and sum(len(content) for _, _, _, content in documents.members(lines, 1 << 20) if content) == info.size
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def signed(files, seed, algorithm="EdDSA", listed=None):
    """The files of an archive with a manifest that is signed by RFC 8032, over ``listed`` or else the files."""
    base = integrity._recovered((4 * pow(5, -1, integrity._P) % integrity._P).to_bytes(32, "little"))

    def packed(point):
        z = pow(point[2], -1, integrity._P)
        x, y = point[0] * z % integrity._P, point[1] * z % integrity._P
        return (y | (x & 1) << 255).to_bytes(32, "little")

    hashes = {n: "sha256:" + hashlib.sha256(c).hexdigest() for n, c in (files if listed is None else listed)}
    text = "".join(f"{n}:{hashes[n]}\n" for n in sorted(hashes)).encode()
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254
    key = packed(integrity._times(a, base))
    r = int.from_bytes(hashlib.sha512(h[32:] + text).digest(), "little") % integrity._L
    point = packed(integrity._times(r, base))
    k = int.from_bytes(hashlib.sha512(point + key + text).digest(), "little") % integrity._L
    signature = point + ((r + k * a) % integrity._L).to_bytes(32, "little")
    return key, [*files, (integrity.MANIFEST, json.dumps({"version": "1.0.0", "algorithm": algorithm, "signature": signature.hex(), "files": hashes}).encode())]


def test_archives_are_verified(spark, tmp_path):
    """Whole archives, and each way in which one can be wrong."""
    files, seed = [("commands/scan.md", b"# Scan"), ("agents/é.md", b"x\n")], b"s" * 32
    key, good = signed(files, seed)
    cases = {
        "good": good,
        "other-key": signed(files, b"t" * 32)[1],
        "none": files,
        "no-json": [*files, (integrity.MANIFEST, b"{")],
        "algorithm": signed(files, seed, "RSA")[1],
        "tampered": [("commands/scan.md", b"# Scam"), *good[1:]],
        "missing": good[1:],
        "untracked": [*good, ("extra", b"")],
        "empty": signed([], seed)[1],
    }
    for name, own in cases.items():
        (tmp_path / f"{name}.tar.gz").write_bytes(gzip.compress(tarred(own)))
    (tmp_path / "cut.tar.gz").write_bytes(gzip.compress(tarred(good)[:700]))
    found = integrity.verify_archives(documents.archive_hashes(spark, str(tmp_path)), key)
    got = {r.archive.rsplit("/", 1)[-1].removesuffix(".tar.gz"): (r.outcome, r.path) for r in found.collect()}
    assert got == {
        "good": ("ok", None), "other-key": ("signature", None), "none": ("no manifest", None), "no-json": ("manifest", None), "algorithm": ("algorithm", None), "tampered": ("mismatch", "commands/scan.md"),
        "missing": ("missing", "commands/scan.md"), "untracked": ("untracked", "extra"), "empty": ("ok", None), "cut": ("unreadable", None),
    }


def test_project_yaml(spark, tmp_path):
    sinks.project_yaml("shop", "critical", [("api", "services/api/"), ("web", "web/")], str(tmp_path / "p.yaml"))
    row = documents.project_config(spark, (tmp_path / "p.yaml").read_text()).first()
    assert (row.project, row.criticality, [tuple(c) for c in row.components]) == ("shop", "critical", [("api", "services/api/"), ("web", "web/")])


def test_listing_by_depth_is_in_order(spark):
    rows = [("b", "n", 2, 0.9), ("a", "n", 1, 0.5), ("c", "n", 1, 0.7), ("s", "", 0, 0.0), ("d", "n", 2, 0.9)]
    nodes = spark.createDataFrame(rows, "entity_id string, entity_type string, depth int, strength double").repartition(3)
    assert [r.entity_id for r in graph.by_depth(nodes).collect()] == ["c", "a", "b", "d"]


def test_editors(spark):
    assert {r.full_support: r.names for r in editors.by_tier(editors.registry(spark, [("b", "B", "b", 1), ("a", "A", "a", 2), ("c", "C", "c", 3)])).collect()} == {True: "a, b", False: "c"}
    state = editors.install_state(spark.createDataFrame([("a",), ("b",)], "editor string"), spark.createDataFrame([("a", "0.9.0")], "editor string, version string"), "0.10.0")
    assert {r.editor: r.outcome for r in state.collect()} == {"a": "update", "b": "new"}


def test_discovery(spark):
    files = [("a", "go.work", "go 1.2\nuse ./svc/x\n./tools\n"), ("a", "services/api/go.mod", None), ("a", "Cargo.toml", '[workspace]\nmembers = ["no"]\n"crates/x",\n'), ("a", "crates/x/Cargo.toml", None), ("a", "package.json", '{"workspaces":{"packages":["packages/*"]}}'), ("a", "packages/p1/index.js", None), ("a", "pom.xml", "<module>m1</module>"), ("a", "m1/pom.xml", None), ("a", "settings.gradle", "include ':app', ':lib:core'\n"), ("a", "app/b", None), ("a", "lib/core/x", None), ("a", "s.sln", 'Project("{X}") = "N", "src\\P\\P.csproj", "{Y}"'), ("a", "src/P/P.csproj", None), ("a", "melos.yaml", "packages:\n  - dart/*\nother: 1\n"), ("a", "dart/d1/pubspec.yaml", ""), ("a", "pubspec.yaml", "name: flut\n"), ("a", "cmd/run/main.go", None), ("a", "web/Dockerfile", None), ("a", "vendor/Dockerfile", None), ("b", "readme", None)]
    found = discovery.components(spark.createDataFrame(files, "repo string, path string, content string"))
    assert {(r.name, r.path) for r in found.collect()} == {("x", "svc/x/"), ("tools", "tools/"), ("x", "crates/x/"), ("p1", "packages/p1/"), ("m1", "m1/"), ("app", "app/"), ("core", "lib/core/"), ("P", "src/P/"), ("d1", "dart/d1/"), ("api", "services/api/"), ("run", "cmd/run/"), ("flut", "."), ("web", "web/")}
    whole = discovery.with_fallback(found, spark.createDataFrame([("a", "pa"), ("b", "pb")], "repo string, project string"))
    assert [(r.name, r.path) for r in whole.filter("repo = 'b'").collect()] == [("pb", ".")]


def test_sources_and_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        documents.submission(spark)
    assert documents.submission(spark, stdin="[]").first().value == "[]"
    assert documents.project_config(spark, "project: p\ncomponents:\n- {name: a, path: a/}\n").first().components[0].name == "a"
    (tmp_path / "c.txt").write_text("a\n\n b\n")
    assert documents.path_list(spark, str(tmp_path / "c.txt")).count() == 2
    (tmp_path / "r.json").write_text('[{"id":"1","score":null}]')
    row = documents.relation(spark, "risk", str(tmp_path / "r.json")).first()
    assert row.score == 0 and row.title == "" and row.linked_services is None
    assert documents.installs(spark, [str(tmp_path / "none.json")]).count() == 0
    text = sinks.managed_block("head\n", "one", "<!--b-->", "<!--e-->")
    assert sinks.managed_block(text, "two", "<!--b-->", "<!--e-->").count("<!--b-->") == 1
    sinks.markdown_summary({"critical": 1}, "hold", str(tmp_path / "s.md"))
    assert "| critical | 1 |" in (tmp_path / "s.md").read_text()
    df = spark.createDataFrame([("a", 0), ("b", 2)], "k string, v int")
    df.write.json(str(tmp_path / "t"))
    sinks.overwrite_keyed(spark.read.schema("k string, v int").json(str(tmp_path / "t")).filter("v > 0"), str(tmp_path / "t"))
    assert spark.read.schema("k string, v int").json(str(tmp_path / "t")).count() == 1
    assert sorted(r.json for r in sinks.json_lines(df, ["v"]).collect()) == ['{"k":"a"}', '{"k":"b","v":2}']
    assert {*SCHEMAS} >= {"risk", "control", "hazard_document"} and empty(spark, "uca").count() == 0


def test_stream(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    live = incidents.run_to_completion(incidents.windowed_history(incidents.incidents(stream), watermark="60 days"), "live", str(tmp_path / "cp"), mode="complete")
    batch = incidents.windowed_history(incidents.incidents(events))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect())) and batch.count() > 0
    assert incidents.sessions(incidents.incidents(events)).agg(F.sum("n")).first()[0] == events.filter("event_type = 'error'").count()


def test_parents_without_pairs(spark):
    """Parents of many equal titles, with equal places and missing titles, by brute force; no join lists pairs."""
    r = random.Random(1)
    title = lambda: r.choice([None, "a", "b", "c"])
    rows = [(i, r.randrange(40), title(), r.choice(["top", "intermediate", "immediate", "odd"]), title()) for i in range(150)]
    df = spark.createDataFrame(rows, "scenario_id long, pos int, title string, level string, parent_title string")
    found = hazard.resolve_parents(df)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    at = lambda x: (hazard.LEVELS.get(x[3], 0), x[1])
    expected = {x[0]: max(((at(y), y[0]) for y in rows if y[2] is not None and y[2] == x[4] and at(y) < at(x)), default=(None, None))[1] for x in rows}
    assert {x.scenario_id: x.parent_id for x in found.collect()} == expected


def test_whole_tables(spark, sf):
    r = Relations(spark, sf)
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    for name in ("scenario_parent_resolve", "scenario_level_order", "risk_detail"):
        assert catalogue.queries()[name](spark, sf).count() == n
    mapped = r.risk_control.join(r.risk.select(F.col("id").alias("risk_id")), "risk_id").select("risk_id").distinct().count()
    assert catalogue.queries()["risk_context_controls"](spark, sf).count() == mapped


def test_context_has_partitions_by_its_input(spark, sf, monkeypatch):
    """A larger table is dealt over more partitions in every exchange of the large tables, with the same rows."""
    names = ("risk_context_controls", "risk_context_sections", "risk_detail")
    plain = {name: sorted(map(repr, catalogue.queries()[name](spark, sf).collect())) for name in names}
    size = scratch._bytes_read(spark.read.parquet(f"{sf}/lineitem.parquet"))
    monkeypatch.setattr(scratch, "DEALT_BYTES", size // 9)
    for name in names:
        df = catalogue.queries()[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(risk_id" in plan and not [line for line in plan.splitlines() if "Exchange hashpartitioning(risk_id" in line and ", 9)" not in line]
        assert sorted(map(repr, df.collect())) == plain[name]


def test_parents_of_the_own_document(spark):
    rows = [(1, 1, 0, "a", "top", None), (2, 2, 0, "b", "top", None), (3, 2, 1, "c", "immediate", "a"), (4, 1, 1, "d", "immediate", "a")]
    df = spark.createDataFrame(rows, "scenario_id long, document_id int, pos int, title string, level string, parent_title string")
    assert {r.scenario_id: r.parent_id for r in hazard.resolve_parents(df).collect()} == {1: None, 2: None, 3: None, 4: 1}


def test_reasons_stay(spark, register):
    first = risks.with_status(register, spark.createDataFrame([("R-1",)], "risk_code string"), "accepted", "why")
    then = {r.risk_code: r for r in risks.with_status(first, spark.createDataFrame([("R-2",)], "risk_code string"), "resolved").collect()}
    assert (then["R-1"].status, then["R-1"].status_reason) == ("accepted", "why") and then["R-2"].status_reason == "Resolved" and then["R-3"].status_reason is None


def test_detail_by_id(spark):
    same = spark.createDataFrame([(1, "R-1"), (2, "R-1")], "id int, risk_code string")
    control = spark.createDataFrame([(7, "RC-7", "n", "c", "t"), (8, "RC-8", "n", "c", "t")], "id int, control_code string, name string, category string, type string")
    found = risks.detail(same, spark.createDataFrame([(1, 7), (2, 8)], "risk_id int, control_id int"), control)
    assert {r.id: [c.control_code for c in r.mapped_controls] for r in found.collect()} == {1: ["RC-7"], 2: ["RC-8"]}


def test_last_of_equal_keys(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", i) for i in range(2, 30)] + [("b", 7), ("b", None)], "k string, v int")
    assert sorted(map(repr, map(tuple, graph.upsert(old, new, ["k"]).collect()))) == ["('a', 29)", "('b', None)"]


def test_interrupted_overwrite(spark, tmp_path):
    """A table that was set aside and not replaced comes back; one whose successor is in place goes."""
    at = str(tmp_path / "t")
    spark.createDataFrame([("a", 1)], "k string, v int").write.json(at + "._old")
    sinks.restore_keyed(spark, at)
    assert spark.read.json(at).count() == 1
    spark.createDataFrame([("b", 1)], "k string, v int").write.json(at + "._old")
    sinks.overwrite_keyed(spark.read.schema("k string, v int").json(at).filter("v > 5"), at)
    assert spark.read.schema("k string, v int").json(at).count() == 0 and not [p for p in tmp_path.iterdir() if p.name != "t"]


def test_source_tree_reads_few(spark, tmp_path):
    for name, text in {"r/go.work": "use ./a", "r/src/big.bin": "x", "r/all.sln": "y", "r/melos.yaml.bak": "z"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = documents.source_tree(spark, str(tmp_path))
    assert {(r.repo, r.path): r.content for r in tree.collect()} == {("r", "go.work"): "use ./a", ("r", "src/big.bin"): None, ("r", "all.sln"): "y", ("r", "melos.yaml.bak"): None}


def test_project_file(spark, tmp_path):
    names = [".now.yaml", ".before.yaml"]
    assert documents.project_file(spark, str(tmp_path), names).count() == 0
    (tmp_path / ".before.yaml").write_text("project: old\n")
    assert documents.project_file(spark, str(tmp_path), names).first().project == "old"
    (tmp_path / ".now.yaml").write_text("project: new\n")
    assert documents.project_file(spark, str(tmp_path), names).first().project == "new" and (tmp_path / ".before.yaml").exists()


def test_levels_are_planned_once(spark):
    """The plan of a deep traversal has as many joins as that of a shallow one."""
    edges = spark.createDataFrame([("n", f"v{i}", "n", f"v{i + 1}", "causes", 1.0, "") for i in range(12)] + [("n", "v5", "n", "v2", "causes", 1.0, "bidirectional")], EDGES)
    found = graph.traverse(edges, "v0", max_depth=9)
    assert {r.entity_id: r.depth for r in found.collect()} == {**{f"v{i}": i for i in range(1, 6) if i != 5}, "v5": 3, "v6": 4, "v7": 5, "v8": 6, "v9": 7, "v10": 8, "v11": 9}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    paths = {tuple(r.path): r.depth for r in graph.foresight(edges, "v4", depth=3).collect()}
    assert paths == {("v4", "v5"): 1, ("v4", "v5", "v6"): 2, ("v4", "v5", "v2"): 2, ("v4", "v5", "v6", "v7"): 3, ("v4", "v5", "v2", "v3"): 3}


def test_search_of_odd_vectors(spark):
    v = spark.createDataFrame([(3, None), (2, [1.0]), (1, [0.0, 1.0]), (5, [3.0, 4.0]), (4, [6.0, 8.0])], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0])], "query_id string, query_vector array<double>")
    rows = knowledge.semantic_search(v, q, 4).collect()
    assert [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == "a"] == [(4, 1.0), (5, 1.0), (1, 0.8), (2, None)]
    assert [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == "b"] == [(1, None), (2, None), (3, None), (4, None)]
    assert knowledge.semantic_search(v.limit(0), q).count() == 0 and knowledge.semantic_search(v, q.limit(0)).count() == 0


def test_signatures(spark):
    """The second and third vectors of RFC 8032, and what is wrong with them when a bit is turned."""
    vectors = [
        ("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", b"\x72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
        ("fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", b"\xaf\x82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
    ]
    for key, message, signature in vectors:
        assert integrity.ed25519_valid(bytes.fromhex(key), bytes.fromhex(signature), message)
        assert not integrity.ed25519_valid(bytes.fromhex(key), bytes.fromhex(signature), message + b"x")
        assert not integrity.ed25519_valid(bytes.fromhex(key)[::-1], bytes.fromhex(signature), message)
    key, _, signature = vectors[0]
    rows = spark.createDataFrame([("r", signature, "EdDSA"), ("r", signature, "RSA"), ("s", signature, "EdDSA"), ("r", "zz", "EdDSA"), ("r", None, "EdDSA")], "canonical string, signature string, algorithm string")
    assert [r.verified for r in integrity.verify_signature(rows, bytes.fromhex(key)).collect()] == [True, False, False, False, False]


def test_editor_registry(spark):
    rows = editors.registry(spark).collect()
    assert len({r.name for r in rows}) == len(rows) == 22 and {r.tier for r in rows} == {1, 2, 3}
