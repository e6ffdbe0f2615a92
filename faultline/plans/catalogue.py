"""The engine's own query catalogue: each entry is a query over a folder of tables and, where SQL can say it, its oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators import controls as C
from faultline.operators import discovery as D
from faultline.operators import editors as E
from faultline.operators import graph as G
from faultline.operators import hazard as H
from faultline.operators import ingest as I
from faultline.operators import integrity as V
from faultline.operators import knowledge as K
from faultline.operators import risks as R
from faultline.operators import vector_index as X
from faultline.plans.relations import VIEWS, Relations, with_views
from faultline.sources import sinks
from faultline.sources.scratch import dealt, partitions_of, shared_folder
from faultline.streaming import incidents as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str | None = None, recursive: bool = False):
    """Registers a function of the relations under its own name, with the oracle's SQL after the named views."""

    def register(f: Callable[[Relations], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if sql is not None:
            _ORACLES[f.__name__] = with_views(views, sql, recursive)
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


_PRIORITY = "case when score >= 80 then 'CRITICAL' when score >= 60 then 'HIGH' when score >= 40 then 'MEDIUM' else 'LOW' end"
_TITLE_CASE = "array_to_string(list_transform(string_split({0}, '_'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
_READY = f"""select cast(row_number() over (order by score desc, id) as int) as rank, risk_code, score, {_PRIORITY} as priority, substr({_TITLE_CASE.format('category')}, 1, 18) as category,
  case when length(title) > 42 then substr(title, 1, 42) || '...' else title end as title from risk where status = 'detected'"""

# --- Risks -------------------------------------------------------------------------------------------------------


@query("risk", f"{_READY} order by rank limit 10")
def risk_ready_topk(r):
    return R.ready(r.risk)


@query("risk", f"{_READY} and category = 'urgent' order by rank limit 25")
def risk_ready_by_category(r):
    return R.ready(r.risk, category="urgent", limit=25)


_LONG = "risk as (select * replace (title || ' ' || repeat('x', id % 31) as title) from orders_risk)"


@query("", f"""orders_risk as ({VIEWS['risk']}), {_LONG} {_READY} order by rank limit 200""")
def risk_ready_long_titles(r):
    """Titles on both sides of the length at which they are cut."""
    return R.ready(r.risk.withColumn("title", F.concat("title", F.lit(" "), F.repeat(F.lit("x"), (F.col("id") % 31).cast("int")))), limit=200)


@query("risk", "select cast(count(*) as bigint) as total_open, greatest(count(*) - 10, 0) as remaining from risk where status = 'detected'")
def risk_ready_remaining(r):
    return R.remaining(r.risk)


@query("risk", "select risk_code, status, score, category, title from risk where status = 'detected' and category = 'high'")
def risk_list_filtered(r):
    return R.list_risks(r.risk, status="detected", category="high")


@query("risk_control control", "select o_orderkey as risk_id, count(*) as n from orders join risk_control on risk_id = o_orderkey join control c on c.id = control_id where c.control_code = 'RC-7' group by 1")
def risk_by_member_control(r):
    """Existential filter over an array column."""
    arrays = r.risk_control.join(r.control.select(F.col("id").alias("control_id"), "control_code"), "control_id").groupBy("risk_id").agg(F.array_sort(F.collect_set("control_code")).alias("control_codes"))
    return R.filtered(arrays, member={"control_codes": "RC-7"}).select("risk_id", F.size(F.filter("control_codes", lambda c: c == "RC-7")).cast("long").alias("n"))


@query("risk", "select risk_code, title, score, strftime(last_seen_at, '%Y-%m-%d') as stale_since from risk where status = 'accepted'")
def risk_stale(r):
    since = F.when(F.col("status") == "accepted", F.date_format("last_seen_at", "yyyy-MM-dd")).otherwise("")
    return R.stale(r.risk.withColumn("stale_since", since))


@query("risk risk_control control", "select risk_code, control_code, name, c.category, type from risk r join risk_control on risk_id = r.id join control c on c.id = control_id")
def risk_show_controls(r):
    return R.mapped_controls(r.risk, r.risk_control, r.control)


@query("risk", """t as (select row_number() over (order by score desc, risk_code) as n, * from risk where status = 'detected' qualify n <= 1000)
  select 0 as place, 'Total Risks: ' || cast(count(*) as varchar) as line from risk where status = 'detected' union all select 1, ''
  union all select 2, rpad('CODE', 10, ' ') || ' ' || rpad('STATUS', 12, ' ') || ' ' || rpad('SCORE', 8, ' ') || ' ' || rpad('CATEGORY', 20, ' ') || ' ' || rpad('TITLE', 50, ' ') union all select 3, repeat('-', 110)
  union all select n + 3, rpad(risk_code, 10, ' ') || ' ' || rpad('[' || upper(status) || ']', 12, ' ') || ' ' || rpad(cast(score as varchar), 8, ' ') || ' ' || rpad(category, 20, ' ') || ' ' || rpad(title, 50, ' ') from t""")
def risk_list_table(r):
    """The list's first thousand lines, its limit."""
    return R.table_lines(r.risk, status="detected")


@query("risk", "select risk_code, id from (select concat('R-', cast(c_custkey * 7 as varchar)) as risk_code from customer) left join risk using (risk_code)")
def risk_lookup_by_code(r):
    return R.lookup(r.risk, r.table("customer").select(F.concat(F.lit("R-"), (F.col("c_custkey") * 7).cast("string")).alias("risk_code")))


@query("risk", f"select status, count(*) as total, {', '.join(f'''count(*) filter ({_PRIORITY} = '{p}') as {p.lower()}''' for p in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW'))} from risk group by status")
def risk_priority_summary(r):
    return R.priority_summary(r.risk)


@query("risk", f"""select count(*) as total, count(*) filter (id % 3 = 0) as created, count(*) filter (id % 3 = 1) as updated, count(*) filter (id % 3 = 2) as unchanged,
  {', '.join(f'''count(*) filter ({_PRIORITY} = '{p}') as {p.lower()}''' for p in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW'))} from risk""")
def risk_scan_summary(r):
    action = F.when(F.col("id") % 3 == 0, "created").when(F.col("id") % 3 == 1, "updated").otherwise("unchanged")
    return R.scan_summary(r.risk.withColumn("action", action))


@query("risk", "select risk_code, case when id % 10 = 0 then 'resolved' else status end as status, case when id % 10 = 0 then 'Resolved' end as status_reason from risk")
def risk_resolve_apply(r):
    return R.with_status(r.risk, r.risk.filter("id % 10 = 0").select("risk_code"), "resolved").select("risk_code", "status", "status_reason")


@query("risk", "select risk_code, case when id % 9 = 0 then 'accepted' else status end as status, case when id % 9 = 0 then '' end as status_reason from risk")
def risk_accept_apply(r):
    return R.with_status(r.risk, r.risk.filter("id % 9 = 0").select("risk_code"), "accepted").select("risk_code", "status", "status_reason")


@query("risk risk_control control evidence", """t as (select risk_id, control_id, string_agg(distinct type, '+' order by type) as types from evidence group by all)
  select risk_code, string_agg(control_code || ':' || coalesce(types, ''), ',' order by control_code) as controls from risk r join risk_control b on b.risk_id = r.id join control c on c.id = b.control_id
  left join t on t.risk_id = b.risk_id and t.control_id = b.control_id group by risk_code""")
def risk_context_controls(r):
    """Nested context, flattened for comparison."""
    df = R.context(r.risk, r.risk_control, r.control, r.evidence).filter(F.size("controls") > 0)
    flat = F.array_join(F.transform("controls", lambda c: F.concat(c["control_code"], F.lit(":"), F.array_join(c["evidence_types"], "+"))), ",")
    return df.select("risk_code", flat.alias("controls"))


@query("risk pattern procedure_stats incident", """points as (select l_orderkey as risk_id, string_agg(concat(l_returnflag, ':', cast(n as varchar)), ',' order by l_returnflag) as breakdown from (select l_orderkey, l_returnflag, count(*) as n from lineitem group by all) group by 1),
  pat as (select l_orderkey as risk_id, p.id, p.occurrence_count as score from lineitem join part on p_partkey = l_partkey join pattern p on p.vertical = p_type and starts_with(p.id, l_returnflag || l_linestatus)),
  pats as (select risk_id, string_agg(id, ',' order by score desc, id) as patterns from (select distinct * from pat) group by 1),
  pro as (select distinct l_orderkey as risk_id, p_brand as id, cast(success_count as double) / applied_count as score from lineitem join part on p_partkey = l_partkey join procedure_stats s on s.id = p_brand),
  pros as (select risk_id, string_agg(id, ',' order by score desc, id) as procedures from pro group by 1),
  inc as (select service_id, count(*) as total_incidents, arg_max(title, (ts, id)) as most_recent_title from incident group by 1)
  select risk_code, coalesce(breakdown, '') as breakdown, coalesce(patterns, '') as patterns, coalesce(procedures, '') as procedures, total_incidents, most_recent_title from risk r
  left join points on points.risk_id = r.id left join pats on pats.risk_id = r.id left join pros on pros.risk_id = r.id left join inc on inc.service_id = r.service_id""")
def risk_context_sections(r):
    """The sections beside the controls: score breakdown, patterns, procedures, incidents of the service."""
    lines = r.table("lineitem").select(F.col("l_orderkey").alias("risk_id"), "l_returnflag", "l_linestatus", F.col("l_partkey").alias("p_partkey"))
    n = partitions_of(lines)
    lines = dealt(dealt(lines, n, "p_partkey").join(r.table("part"), "p_partkey"), n, "risk_id")
    factors = lines.groupBy("risk_id", F.col("l_returnflag").alias("source")).agg(F.count(F.lit(1)).alias("points")).withColumn("description", F.lit(""))
    kind = F.concat("l_returnflag", "l_linestatus", F.lit("-"), "p_type")
    patterns = lines.select("risk_id", kind.alias("id")).distinct().join(r.pattern.select("id", F.col("occurrence_count").alias("score")), "id")
    procedures = lines.select("risk_id", F.col("p_brand").alias("id")).distinct().join(r.procedure.select("id", (F.col("success_count").cast("double") / F.col("applied_count")).alias("score")), "id")
    df = R.context(r.risk, r.risk_control, r.control, r.evidence, r.incident, factors=factors, patterns=patterns, procedures=procedures)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), ",").alias(c)
    breakdown = F.array_join(F.transform("score_breakdown", lambda x: F.concat(x["source"], F.lit(":"), x["points"].cast("string"))), ",")
    return df.select("risk_code", breakdown.alias("breakdown"), ids("patterns"), ids("procedures"), "total_incidents", "most_recent_title")


@query("", """select l_orderkey as risk_id, l_returnflag as source, cast(sum(case when l_returnflag = 'R' then -cast(l_quantity as bigint) else cast(l_quantity as bigint) end) as bigint) as points, count(*) as factors
  from lineitem group by all""")
def score_breakdown(r):
    points = F.col("l_quantity").cast("long") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return R.score_breakdown(r.table("lineitem").select(F.col("l_orderkey").alias("risk_id"), F.col("l_returnflag").alias("source"), points.alias("points")))


@query("risk risk_control control", """select risk_code, coalesce(string_agg(control_code || '/' || type, ',' order by control_code), '') as mapped from risk r left join risk_control b on b.risk_id = r.id left join control c on c.id = b.control_id
  group by risk_code""")
def risk_detail(r):
    df = R.detail(r.risk, r.risk_control, r.control)
    flat = F.array_join(F.transform("mapped_controls", lambda c: F.concat(c["control_code"], F.lit("/"), c["type"])), ",")
    return df.select("risk_code", F.coalesce(flat, F.lit("")).alias("mapped"))


# --- Controls and evidence ---------------------------------------------------------------------------------------


@query("control", """select control_code, '[' || upper(type) || ']' as type, cast(weight as varchar) || '/10' as weight,
  case when weight >= 9 then 'Critical' when weight >= 7 then 'Required' when weight >= 5 then 'Important' when weight >= 3 then 'Recommended' else 'Advisory' end as tier, category, name from control""")
def control_list_tiers(r):
    return C.list_controls(r.control)


_CONTROL_ROWS = """select control_code, '[' || upper(type) || ']' as type, cast(weight as varchar) || '/10' as weight,
  case when weight >= 9 then 'Critical' when weight >= 7 then 'Required' when weight >= 5 then 'Important' when weight >= 3 then 'Recommended' else 'Advisory' end as tier, category, name from control"""


@query("control", f"{_CONTROL_ROWS} where category = (select min(category) from control)")
def control_list_category(r):
    first = r.control.agg(F.min("category")).first()[0]
    return C.list_controls(r.control, category=first)


@query("control", f"{_CONTROL_ROWS} order by control_code limit 50")
def control_page(r):
    """The list as it is by default, which is its limit's."""
    return C.control_page(r.control)


@query("evidence control", """e as (select 'ev-' || cast(risk_id as varchar) || '-' || cast(control_id as varchar) as id, sha256(cast(risk_id as varchar)) as git_hash, * from evidence)
  select substr(e.id, 1, 8) as short_id, control_code, e.type, '[' || upper(status) || ']' as badge, e.id as name, substr(git_hash, 1, 8) as commit from e join control c on c.id = control_id where control_code = 'RC-7' order by e.id limit 20""")
def evidence_page(r):
    """The list of one control as it is by default, which is its limit's."""
    name = F.concat_ws("-", F.lit("ev"), F.col("risk_id").cast("string"), F.col("control_id").cast("string"))
    rows = r.evidence.withColumns({"id": name, "name": name, "git_hash": F.sha2(F.col("risk_id").cast("string"), 256)})
    return C.evidence_page(rows, r.control, control_code="RC-7")


@query("", """c as (select p_partkey % 50 as code, ['code', 'test', 'document'][cast(p_size % 3 as int) + 1] as expected from part), s as (select s_suppkey as id, 'RC-' || cast(s_suppkey as varchar) as control_code, ['code', 'test'][cast(s_suppkey % 2 as int) + 1] as type from supplier)
  select id, s.control_code, s.type, exists (select 1 from part p where 'RC-' || cast(p_partkey as varchar) = s.control_code and ['code', 'test', 'document'][cast(p_size % 3 as int) + 1] = s.type) as expected from s""")
def evidence_expected_type(r):
    k = F.col("s_suppkey")
    kinds = F.array(F.lit("code"), F.lit("test"), F.lit("document"))
    control = r.table("part").select(F.concat(F.lit("RC-"), F.col("p_partkey").cast("string")).alias("control_code"), F.array(F.get(kinds, F.col("p_size") % 3)).alias("expected_evidence_types"))
    new = r.table("supplier").select(k.alias("id"), F.concat(F.lit("RC-"), k.cast("string")).alias("control_code"), F.get(kinds, (k % 2).cast("int")).alias("type"))
    return C.expected_type(control, new)


@query("control risk_control risk", "select control_code, count(*) as n_risks, count(*) filter (status = 'detected') as n_open, max(score) as max_score from control c join risk_control on control_id = c.id join risk r on r.id = risk_id group by 1")
def control_show_risks(r):
    return C.control_risks(r.control, r.risk_control, r.risk)


@query("control", "select id, control_code from control where control_code = 'RC-11'")
def control_by_code(r):
    return C.by_code(r.control, "RC-11").select("id", "control_code")


@query("control", "select code, case when starts_with(code, 'RC-') then 'control' when starts_with(code, 'R-') then 'risk' else 'unknown' end as kind from (select control_code as code from control union all select concat('R-', cast(s_suppkey as varchar)) from supplier union all select r_name from region)")
def code_guard(r):
    codes = r.control.select(F.col("control_code").alias("code")).unionByName(r.table("supplier").select(F.concat(F.lit("R-"), F.col("s_suppkey").cast("string")).alias("code"))).unionByName(r.table("region").select(F.col("r_name").alias("code")))
    return codes.withColumn("kind", C.code_kind("code"))


@query("evidence control", "select risk_id, control_code, e.type, status, '[' || upper(status) || ']' as badge from evidence e join control c on c.id = control_id where e.type = 'test' and status = 'verified'")
def evidence_list_filtered(r):
    return C.list_evidence(r.evidence, r.control, type="test", status="verified").select("risk_id", "control_code", "type", "status", "badge")


@query("evidence control", "select control_code, gap from control c, (values ('code'), ('document'), ('test')) as x(gap) where not exists (select 1 from evidence e where e.control_id = c.id and e.type = gap)")
def evidence_gaps(r):
    return C.evidence_gaps(r.control, r.evidence)


@query("evidence", "select risk_id as id, case when risk_id % 5 = 0 then 'verified' else status end as status, case when risk_id % 5 = 0 then '2024-01-01T00:00:00Z' end as verified_at from evidence")
def evidence_verify(r):
    rows = r.evidence.withColumnRenamed("risk_id", "id")
    return C.verify_evidence(rows, rows.filter("id % 5 = 0"), "2024-01-01T00:00:00Z").select("id", "status", "verified_at")


@query("incident", """select service_id, count(*) as total_incidents, count(*) filter (ts >= m - interval 30 day) as last_30_days, count(*) filter (ts >= m - interval 90 day) as last_90_days,
  count(*) filter (severity = 'critical') as critical_count, count(*) filter (severity = 'high') as high_count, arg_max(id, (ts, id)) as most_recent_id, arg_max(title, (ts, id)) as most_recent_title, round(avg(value), 6) as average_value
  from incident, (select max(ts) as m from incident) group by service_id""")
def incident_history(r):
    return C.incident_history(r.incident).withColumn("average_value", F.round("average_value", 6))


# --- Knowledge ---------------------------------------------------------------------------------------------------


@query("fact", "select id, vertical, technology, confidence from fact where vertical = 'fr' and technology = 'src3' and validation_status = 'analyst_validated'")
def facts_filtered(r):
    return K.facts(r.fact, vertical="fr", technology="src3", status="analyst_validated").select("id", "vertical", "technology", "confidence")


@query("procedure_stats procedure_control", """q as (select unnest(['RC-5', 'RC-none']) as code), hit as (select code, procedure_id as id from q join procedure_control on control_code = code)
  select code, p.id, applied_count, success_count, exists (select 1 from hit h where h.code = q.code) as matched from q, procedure_stats p
  where exists (select 1 from hit h where h.code = q.code and h.id = p.id) or not exists (select 1 from hit h where h.code = q.code)""")
def procedures_by_control_fallback(r):
    one, other = (K.procedures_for_control(r.procedure, code).select(F.lit(code).alias("code"), "id", "applied_count", "success_count", "matched") for code in ("RC-5", "RC-none"))
    return one.unionByName(other)


_PROCEDURES = "p as (select p_brand as id, 'v' || cast(count(*) % 3 as varchar) as vertical, case when count(*) % 2 = 0 then 'runbook' else 'playbook' end as procedure_type, list(distinct p_type) as technologies, list(distinct 'RC-' || cast(p_partkey as varchar)) as related from part group by 1)"


def _procedures(r):
    n = F.count(F.lit(1))
    return r.table("part").groupBy(F.col("p_brand").alias("id")).agg(F.concat(F.lit("v"), (n % 3).cast("string")).alias("vertical"), F.when(n % 2 == 0, "runbook").otherwise("playbook").alias("procedure_type"), F.collect_set("p_type").alias("technologies"), F.collect_set(F.concat(F.lit("RC-"), F.col("p_partkey").cast("string"))).alias("related_controls"))


@query("", f"{_PROCEDURES} select id, vertical, procedure_type from p where procedure_type = 'runbook' and vertical = 'v1' and list_contains(technologies, (select max(p_type) from part))")
def procedures_filtered(r):
    last = r.table("part").agg(F.max("p_type")).first()[0]
    return K.procedures(_procedures(r), vertical="v1", technology=last, type="runbook").select("id", "vertical", "procedure_type")


@query("", f"{_PROCEDURES} select id, procedure_type from p where list_contains(related, 'RC-5')")
def procedures_of_control(r):
    return K.procedures(_procedures(r), control="RC-5").select("id", "procedure_type")


@query("pattern", "select id, vertical, occurrence_count from pattern where occurrence_count >= 150")
def patterns_min_occurrences(r):
    return K.patterns(r.pattern, min_occurrences=150)


@query("fact procedure_stats pattern", """select count(*) as total_facts, 100.0::double * count(*) filter (validation_status = 'analyst_validated') / count(*) as validated_percentage, round(avg(confidence), 9) as avg_confidence,
  count(*) filter (id % 9 = 0) as stale_count, count(*) filter (validation_status = 'contradicted') as contradiction_count, (select count(*) from procedure_stats) as total_procedures, (select count(*) from pattern) as total_patterns,
  count(*) + (select count(*) from procedure_stats) + (select count(*) from pattern) as total from fact""")
def knowledge_health(r):
    return _health(r).withColumn("avg_confidence", F.round("avg_confidence", 9))


def _health(r):
    facts = r.fact.drop("content").withColumn("stale_since", F.when(F.col("id") % 9 == 0, "2024-01-01").otherwise(""))
    return K.health(facts, r.procedure, r.pattern)


_TOPK = """q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 100 = 0),
  s as (select query_id, vec_id, list_cosine_similarity(embedding::double[], e::double[]) as score from embeddings, q)
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, round(score, 4) as score from s qualify rank <= 20"""


@query("", _TOPK)
def search_cosine_topk(r):
    return _cosine(r).withColumn("score", F.round("score", 4))


def _asked(r):
    v = r.table("embeddings").select("vec_id", "embedding")
    return v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _cosine(r, which: str = "true"):
    vectors, queries = _asked(r)
    return K.semantic_search(vectors, queries.filter(which))


@query("", _TOPK)
def search_index_exact(r):
    """The same by the index: what angles rule out is not compared."""
    vectors, queries = _asked(r)
    return X.search(X.build(vectors), queries, exact=True).withColumn("score", F.round("score", 4))


@query("", "select count(*) filter (vec_id % 100 = 0) * least(20, count(*)) as n_wanted, true as enough from embeddings")
def search_index_recall(r):
    """Whether looking into the nearest cells alone finds 0.95 of what a comparison with all vectors does."""
    vectors, queries = _asked(r)
    return X.recall(X.search(X.build(vectors), queries), _cosine(r)).select("n_wanted", (F.col("recall") >= 0.95).alias("enough"))


@query("", """q as (select embedding as e from embeddings where vec_id = 0), s as (select vec_id, list_cosine_similarity(embedding::double[], e::double[]) as score from embeddings, q order by score desc, vec_id limit 20),
  g as (select vec_id, 0.5::double as graph_score from embeddings where label = (select label from embeddings where vec_id = 0)), m as (select coalesce(s.vec_id, g.vec_id) as id, score, graph_score from s full join g on s.vec_id = g.vec_id)
  select id, round(score, 4) as score, graph_score, case when score is not null and graph_score is not null then 'both' when score is not null then 'semantic' else 'graph' end as discovery_method,
  case when score is not null and graph_score is not null then '[SEM+GRAPH]' when score is not null then '[SEM]' else '[GRAPH]' end as badge from m""")
def graph_search_merge(r):
    v = r.table("embeddings")
    hits = _cosine(r, "query_id = 0").select(F.col("vec_id").alias("id"), "score")
    label = v.filter("vec_id = 0").select("label")
    near = v.join(F.broadcast(label), "label", "left_semi").select(F.col("vec_id").alias("id"), F.lit(0.5).alias("graph_score"))
    return K.graph_search(hits, near).withColumn("score", F.round("score", 4))


_LINKS = """e as (select 'v' || cast(vec_id as varchar) as src, 'v' || cast(to_id as varchar) as dst, strength from
  (select vec_id, unnest([(vec_id * 7 + 3) % n, (vec_id * 5 + 1) % n]) as to_id, unnest([(vec_id % 10) / 10.0::double, 0.8::double]) as strength from embeddings, (select count(*) as n from embeddings)) where strength >= 0.3::double)"""


@query("", f"""q as (select embedding as e from embeddings where vec_id = 0), s as (select 'v' || cast(vec_id as varchar) as id, list_cosine_similarity(embedding::double[], e::double[]) as score from embeddings, q order by score desc, vec_id limit 20),
  {_LINKS}, one as (select s.id as seed, dst as id, 1 as depth, max(strength) as strength, s.id || ' -> ' || dst as path from s join e on src = s.id where dst <> s.id group by s.id, dst),
  two as (select seed, dst as id, 2 as depth, arg_min((e.strength, path || ' -> ' || dst), (-e.strength, path)) as b from one join e on src = one.id where dst <> seed and not exists (select 1 from one o where o.seed = one.seed and o.id = dst) group by seed, dst),
  r as (select seed, id, depth, strength, path from one union all select seed, id, depth, b[1], b[2] from two),
  g as (select id, arg_min((strength, path, depth), (depth, -strength, path)) as b from r group by id)
  select coalesce(s.id, g.id) as id, round(score, 4) as score, b[1] as graph_score, b[2] as graph_path, b[3] as depth, case when score is not null and b is not null then 'both' when score is not null then 'semantic' else 'graph' end as discovery_method,
  case when score is not null and b is not null then '[SEM+GRAPH]' when score is not null then '[SEM]' else '[GRAPH]' end as badge from s full join g on s.id = g.id""")
def graph_search_expanded(r):
    """The nearest vectors of one, and what links lead to from them in two steps."""
    v = r.table("embeddings").select("vec_id")
    n, k = v.count(), F.col("vec_id")
    node = lambda x: F.concat(F.lit("v"), x.cast("string"))
    links = F.array(F.struct(((k * 7 + 3) % n).alias("to"), ((k % 10) / F.lit(10.0)).alias("strength")), F.struct(((k * 5 + 1) % n).alias("to"), F.lit(0.8).alias("strength")))
    edges = v.select("vec_id", F.inline(links)).select(node(k).alias("source_id"), F.lit("vector").alias("source_type"), node(F.col("to")).alias("target_id"), F.lit("vector").alias("target_type"), F.lit("near").alias("relation_type"), "strength")
    hits = _cosine(r, "query_id = 0").select(node(F.col("vec_id")).alias("id"), "score")
    return K.expanded_search(hits, edges, depth=2, types="near").withColumn("score", F.round("score", 4))


@query("pattern procedure_stats fact", """h as (select count(*) as f, 100.0::double * count(*) filter (validation_status = 'analyst_validated') / count(*) as v, avg(confidence) as a, count(*) filter (id % 9 = 0) as s, count(*) filter (validation_status = 'contradicted') as c,
    (select count(*) from procedure_stats) as p, (select count(*) from pattern) as q from fact),
  hs as (select cast(row_number() over (order by id) as int) as rank, * from (select unnest(['total_facts', 'validated_percentage', 'avg_confidence', 'stale_count', 'contradiction_count', 'total_procedures', 'total_patterns', 'total']) as id, unnest([f, v, a, s, c, p, q, f + p + q]::double[]) as score from h)),
  x as (select 'patterns' as section, id, vertical as label, cast(occurrence_count as double) as score from pattern
  union all select 'procedures', id, id, cast(success_count as double) / applied_count from procedure_stats
  union all select 'facts', cast(id as varchar), technology, confidence from fact where technology = 'src3'),
  y as (select section, id, label, score, case section when 'facts' then lpad(id, 12, '0') else id end as k from x)
  select section, cast(row_number() over (partition by section order by score desc, k) as int) as rank, id, label, score from y qualify rank <= 10
  union all select 'health', rank, id, replace(id, '_', ' '), score from hs""")
def enrich_sections(r):
    pat = r.pattern.select("id", F.col("vertical").alias("label"), F.col("occurrence_count").cast("double").alias("score"))
    pro = r.procedure.select("id", F.col("id").alias("label"), (F.col("success_count").cast("double") / F.col("applied_count")).alias("score"))
    fact = K.facts(r.fact, technology="src3").select("id", F.col("technology").alias("label"), F.col("confidence").alias("score"))
    return K.enrich(pat, pro, fact, health=_health(r))


# --- Graph -------------------------------------------------------------------------------------------------------


@query("edge", "select source_id, target_id, relation_type, strength from edge where source_id = 'supplier:3' or target_id = 'supplier:3'")
def relationships_of_entity(r):
    return G.relationships(r.edge, "supplier:3").select("source_id", "target_id", "relation_type", "strength")


@query("edge", """walk as (select target_id as entity_id, target_type as entity_type, 1 as depth, strength from edge where source_id = 'region:1' and strength >= 0.3::double
  union all select e.target_id, e.target_type, depth + 1, e.strength from walk join edge e on e.source_id = walk.entity_id where depth < 3 and e.strength >= 0.3::double)
  select entity_id, entity_type, min(depth) as depth, arg_min(strength, (depth, -strength)) as strength from walk group by entity_id, entity_type""", recursive=True)
def graph_traverse_depth3(r):
    return G.traverse(r.edge, "region:1")


@query("edge", """b as (select source_id, source_type, target_id, target_type, strength from edge where relation_type in ('contains', 'causes') union all select target_id, target_type, source_id, source_type, strength from edge where relation_type = 'contains'
    union all select source_id, source_type, concat('nation:', cast(s_nationkey as varchar)), 'nation', strength from edge join supplier on source_id = concat('supplier:', cast(s_suppkey as varchar)) where relation_type = 'causes'),
  walk as (select target_id as entity_id, target_type as entity_type, 1 as depth, strength from b where source_id = 'supplier:3' and strength >= 0.5::double
  union select e.target_id, e.target_type, depth + 1, e.strength from walk join b e on e.source_id = walk.entity_id where depth < 4 and e.strength >= 0.5::double)
  select entity_id, entity_type, min(depth) as depth, arg_min(strength, (depth, -strength)) as strength from walk where entity_id <> 'supplier:3' group by entity_id, entity_type""", recursive=True)
def graph_traverse_types(r):
    """Relation types, edges that go both ways and cycles: suppliers lead to their nations, nations to regions and back."""
    supplied = r.edge.filter("relation_type = 'causes'")
    nation = r.table("supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("target_id"))
    up = supplied.drop("target_id", "target_type").join(nation, "source_id").withColumn("target_type", F.lit("nation"))
    edges = r.edge.unionByName(up).withColumn("direction", F.when(F.col("relation_type") == "contains", "bidirectional").otherwise(""))
    return G.traverse(edges, "supplier:3", max_depth=4, min_strength=0.5, relation_types="contains, causes")


@query("edge", """walk as (select ['region:1', target_id] as path, target_id as node, 1 as depth, strength as total from edge where source_id = 'region:1' and strength >= 0.3::double
  union all select list_append(path, e.target_id), e.target_id, depth + 1, total * e.strength from walk join edge e on e.source_id = node where depth < 3 and e.strength >= 0.3::double and not list_contains(path, e.target_id))
  select array_to_string(path, '>') as path, depth, round(total, 6) as total_strength from walk""", recursive=True)
def foresight_paths(r):
    return G.foresight(r.edge, "region:1").select(F.array_join("path", ">").alias("path"), "depth", F.round("total_strength", 6).alias("total_strength"))


@query("edge", """s as (select distinct target_id as supplier from edge where source_id = 'nation:3'), m as (select concat('supplier:', cast(s_suppkey as varchar)) as node, s_name as label from supplier where s_acctbal > 0)
  select concat('nation:3>', supplier) as path, coalesce(label, '') as mitigations from s left join m on node = supplier""")
def foresight_mitigations(r):
    paths = G.foresight(r.edge, "nation:3", depth=1)
    mitigations = r.table("supplier").filter("s_acctbal > 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("for_node_id"), F.col("s_name").alias("label"))
    own = F.coalesce(F.array_join(F.transform("mitigations", lambda m: m["label"]), ","), F.lit(""))
    return G.with_mitigations(paths, mitigations).select(F.array_join("path", ">").alias("path"), own.alias("mitigations"))


_WAYS = """walk as (select source_id as seed, [source_id, target_id] as path, target_id as node, 1 as depth, strength as total from edge where source_type = 'region' and strength >= 0.3::double
  union all select seed, list_append(path, e.target_id), e.target_id, depth + 1, total * e.strength from walk join edge e on e.source_id = node where depth < 3 and e.strength >= 0.3::double and not list_contains(path, e.target_id)),
  ranked as (select *, row_number() over (partition by seed order by total desc, depth, path) as n from walk)"""
_KS = (1, 10, 500)


@query("edge", f"{_WAYS} select cast(k as int) as k, seed, cast(n as int) as rank, array_to_string(path, '>') as path, depth, round(total, 6) as total_strength from ranked join (select unnest({[*_KS]}) as k) on n <= k", recursive=True)
def foresight_strongest(r):
    """The first k paths of every region, for several k: the first ones of the largest, found without the others."""
    seeds = r.edge.filter("source_type = 'region'").select(F.col("source_id").alias("entity_id"))
    found = G.strongest_paths(r.edge, seeds, max(_KS)).withColumn("k", F.explode(F.array(*map(F.lit, _KS)))).filter("rank <= k")
    return found.select("k", "seed", "rank", F.array_join("path", ">").alias("path"), "depth", F.round("total_strength", 6).alias("total_strength"))


_BACK = """edges as (select source_id, target_id, strength from edge union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 0.75 + (s_suppkey % 5) / 20.0::double from supplier
  union all select target_id, source_id, strength from edge where relation_type = 'contains'),"""


@query("edge", f"""{_BACK} walk as (select source_id as seed, [source_id, target_id] as path, target_id as node, 1 as depth, strength as total from edges where source_id in (select 'supplier:' || s_suppkey from supplier where s_suppkey % 50 = 0) and strength >= 0.7::double
  union all select seed, list_append(path, e.target_id), e.target_id, depth + 1, total * e.strength from walk join edges e on e.source_id = node where depth < 4 and e.strength >= 0.7::double and not list_contains(path, e.target_id)),
  ranked as (select *, row_number() over (partition by seed order by total desc, depth, path) as n from walk)
  select seed, cast(n as int) as rank, array_to_string(path, '>') as path, depth, round(total, 6) as total_strength from ranked where n <= 40""", recursive=True)
def foresight_strongest_cycles(r):
    """Among edges that go both ways: no path comes back to a node."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    up = r.table("supplier").select(F.lit("supplier").alias("source_type"), key("supplier", "s_suppkey").alias("source_id"), F.lit("nation").alias("target_type"), key("nation", "s_nationkey").alias("target_id"), F.lit("is_in").alias("relation_type"), (F.lit(0.75) + (F.col("s_suppkey") % 5) / F.lit(20.0)).alias("strength"))
    edges = r.edge.unionByName(up).withColumn("direction", F.when(F.col("relation_type") == "contains", "bidirectional").otherwise(""))
    seeds = r.table("supplier").filter("s_suppkey % 50 = 0").select(key("supplier", "s_suppkey").alias("entity_id"))
    return G.strongest_paths(edges, seeds, 40, depth=4, min_strength=0.7).select("seed", "rank", F.array_join("path", ">").alias("path"), "depth", F.round("total_strength", 6).alias("total_strength"))


@query("edge", f"""{_WAYS}, m as (select 'supplier:' || s_suppkey as node, s_name as label from supplier where s_acctbal > 0 union all select 'nation:' || n_nationkey, n_name from nation where n_nationkey % 2 = 0),
  own as (select seed, n, string_agg(label, ',' order by node, label) as labels from (select seed, n, unnest(path) as node from ranked where n <= 300) join m using (node) group by seed, n)
  select seed, cast(r.n as int) as rank, depth, array_to_string(path, '>') as path, coalesce(labels, '') as mitigations from ranked r left join own using (seed, n) where r.n <= 300""", recursive=True)
def foresight_mitigated(r):
    """The strongest paths of several steps with the mitigations of any of their nodes."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("for_node_id")
    mitigations = r.table("supplier").filter("s_acctbal > 0").select(key("supplier", "s_suppkey"), F.col("s_name").alias("label"))
    mitigations = mitigations.unionByName(r.table("nation").filter("n_nationkey % 2 = 0").select(key("nation", "n_nationkey"), F.col("n_name").alias("label")))
    paths = G.strongest_paths(r.edge, r.edge.filter("source_type = 'region'").select(F.col("source_id").alias("entity_id")), 300)
    own = F.coalesce(F.array_join(F.transform("mitigations", lambda m: m["label"]), ","), F.lit(""))
    return G.with_mitigations(paths, mitigations).select("seed", "rank", "depth", F.array_join("path", ">").alias("path"), own.alias("mitigations"))


@query("edge", """walk as (select target_id as id, 1 as depth, strength from edge where source_id = 'region:1' and strength >= 0.3::double
  union all select e.target_id, depth + 1, e.strength from walk join edge e on e.source_id = walk.id where depth < 3 and e.strength >= 0.3::double),
  first as (select id, min(depth) as depth, arg_min(strength, (depth, -strength)) as strength from walk group by id) select depth, count(*) as n, max(strength) as max_strength from first group by depth""", recursive=True)
def graph_depth_counts(r):
    return G.depth_counts(G.traverse(r.edge, "region:1"))


@query("edge", """w as (select ['region:2', target_id] as path, target_id as node, 1 as depth from edge where source_id = 'region:2' and strength >= 0.3::double
  union all select list_append(path, e.target_id), e.target_id, depth + 1 from w join edge e on e.source_id = node where depth < 2 and e.strength >= 0.3::double and not list_contains(path, e.target_id))
  select (select count(*) from edge) as edges_examined, count(*) as n_paths, max(depth) as max_depth, 2 as traversal_depth from w""", recursive=True)
def foresight_metadata(r):
    return G.impact_metadata(r.edge, G.foresight(r.edge, "region:2", depth=2), 2)


# --- Ingest ------------------------------------------------------------------------------------------------------


@query("page_path component", "select page_id, p.path, arg_max(name, length(c.path)) as component from page_path p left join component c on starts_with(p.path, c.path) group by page_id, p.path")
def component_mapping(r):
    return I.longest_prefix(r.page_path, r.component)


@query("page_path component", """m as (select page_id, arg_max(name, length(c.path)) as name from page_path p join component c on starts_with(p.path, c.path) group by page_id)
  select page_id as finding_id, case when page_id % 7 = 0 then 'given' when page_id % 5 = 0 then 'web/named' when name is not null then 'web/' || name else '' end as services from page_path left join m using (page_id)""")
def finding_services(r):
    rows = r.page_path.select(
        F.col("page_id").alias("finding_id"),
        F.when(F.col("page_id") % 7 == 0, F.array(F.lit("given"))).otherwise(F.array().cast("array<string>")).alias("linked_services"),
        F.when(F.col("page_id") % 5 == 0, "named").alias("component"),
        F.array("path").alias("evidence_paths"),
    )
    return I.linked_services(rows, r.component, "web").select("finding_id", F.array_join("linked_services", ",").alias("services"))


@query("", "select event_id, cast(pos as int) as pos, k as finding from (select event_id, unnest([0, 1]) as pos, json_extract_string(props, '$.k') as k from events where event_id % 2 = 0 union all select event_id, 0, json_extract_string(props, '$.k') from events where event_id % 2 = 1)")
def findings_of_either_root(r):
    """Bare arrays of two findings, and objects that list one."""
    two = F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]"))
    one = F.concat(F.lit('{"findings":['), F.col("props"), F.lit("]}"))
    docs = r.table("events").select("event_id", F.when(F.col("event_id") % 2 == 0, two).otherwise(one).alias("value"))
    return I.findings(docs).select("event_id", "pos", F.try_variant_get("finding", "$.k", "string").alias("finding"))


@query("risk", f"select service_id, count(*) filter ({_PRIORITY} = 'CRITICAL') as critical, count(*) filter ({_PRIORITY} = 'HIGH') as high, cast(case when count(*) filter ({_PRIORITY} in ('CRITICAL', 'HIGH')) > 0 then 1 else 0 end as int) as status from risk where status = 'detected' group by service_id")
def ci_gate(r):
    counts = R.open_risks(r.risk).groupBy("service_id").agg(F.count_if(S.priority("score") == "CRITICAL").alias("critical"), F.count_if(S.priority("score") == "HIGH").alias("high"))
    return counts.withColumn("status", I.ci_status(F.col("critical"), F.col("high")))


@query("", """d as (select o_orderkey as id, case o_orderkey % 3 when 0 then 'pass' when 1 then 'hold' else 'warn' end as decision, o_orderkey % 2 = 0 as enforce, o_orderkey % 11 <> 0 as reachable, o_orderkey % 13 <> 0 as parsed, o_orderkey % 5 = 0 as closed from orders)
  select id, case when decision = 'pass' then 'PASS' else 'HOLD' end as label, cast(case when not reachable then case when closed then 1 else 0 end when not parsed then 1 when enforce and decision = 'hold' then 1 else 0 end as int) as status from d""")
def review_gate(r):
    k = F.col("o_orderkey")
    decision = F.when(k % 3 == 0, "pass").when(k % 3 == 1, "hold").otherwise("warn")
    return r.table("orders").select(k.alias("id"), I.review_label(decision).alias("label"), I.review_status(decision, k % 2 == 0, k % 11 != 0, k % 13 != 0, k % 5 == 0).alias("status"))


@query("", """select p_partkey as id, case when ci then 'ci' when auto then 'auto' when review then case when stdin then 'auto' else 'review' end when not tty then 'auto' when stdin then 'auto' else 'review' end as mode,
  case when p_partkey % 4 = 0 then 'origin/' || p_brand when p_partkey % 4 = 1 then 'origin/' || p_type when p_partkey % 4 = 2 then p_name else 'origin/main' end as base
  from (select *, p_partkey % 7 = 0 as ci, p_partkey % 5 = 0 as auto, p_partkey % 3 = 0 as review, p_partkey % 2 = 0 as tty, p_partkey % 11 = 0 as stdin from part)""")
def scan_mode_and_base(r):
    k = F.col("p_partkey")
    named = lambda n, c: F.when(k % 4 == n, F.col(c)).otherwise("")
    return r.table("part").select(k.alias("id"), I.scan_mode(k % 7 == 0, k % 5 == 0, k % 3 == 0, k % 2 == 0, k % 11 == 0).alias("mode"), I.base_ref(named(0, "p_brand"), named(1, "p_type"), named(2, "p_name")).alias("base"))


@query("", """n as (select upper(r_name) as name from region union all select 'nowhere') select name, cast(r_regionkey as int) as organisation_id from n left join region on lower(r_name) = lower(name)""")
def organisation_lookup(r):
    names = r.table("region").select(F.upper("r_name").alias("name")).unionByName(r.spark.createDataFrame([("nowhere",)], "name string"))
    return I.organisation_id(names, r.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


@query("", "select case when p_partkey % 4 = 0 then 'missing control' when p_partkey % 6 = 1 then 'missing name' else 'accepted' end as outcome, count(*) as n from part group by 1")
def submission_outcomes(r):
    k = F.col("p_partkey")
    rows = r.table("part").select(F.when(k % 4 != 0, "RC").alias("control"), F.when(k % 6 == 1, "").otherwise(F.col("p_name")).alias("name"))
    return V.outcome_counts(I.accepted(rows, ["control", "name"]))


# --- Hazard analysis ---------------------------------------------------------------------------------------------


@query("", "select c_custkey as id, c_name as title from customer where lower(c_name) not in (select lower(c_name) from customer where c_custkey % 3 = 0)")
def loss_dedup(r):
    new = r.table("customer").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("title"), "c_name")
    old = r.table("customer").filter("c_custkey % 3 = 0").select(F.col("c_name").alias("title"))
    return H.new_losses(new, old).select("id", F.col("c_name").alias("title"))


_SCENARIOS = """s as (select o_orderkey as scenario_id, o_orderkey as pos, o_custkey % 50 as document_id, concat('t', cast(o_orderkey % 40 as varchar)) as title, case o_orderkey % 4 when 0 then 'top' when 1 then 'intermediate' when 2 then 'immediate' else 'odd' end as level,
  concat('t', cast((o_orderkey + 1) % 45 as varchar)) as parent_title from orders), l as (select *, case level when 'intermediate' then 1 when 'immediate' then 2 else 0 end as rank from s)"""


def _scenarios(r):
    k = F.col("o_orderkey")
    level = F.when(k % 4 == 0, "top").when(k % 4 == 1, "intermediate").when(k % 4 == 2, "immediate").otherwise("odd")
    return r.table("orders").select(k.alias("scenario_id"), k.alias("pos"), (F.col("o_custkey") % 50).alias("document_id"), F.concat(F.lit("t"), (k % 40).cast("string")).alias("title"), level.alias("level"), F.concat(F.lit("t"), ((k + 1) % 45).cast("string")).alias("parent_title"))


@query("", f"""{_SCENARIOS}, o as (select *, cast(rank as hugeint) * 1000000000000 + pos as place from l), t as (select document_id, title, place, scenario_id from o)
  select o.scenario_id, t.scenario_id as parent_id from o asof left join t on t.document_id = o.document_id and t.title = o.parent_title and o.place > t.place""")
def scenario_parent_resolve(r):
    return H.resolve_parents(_scenarios(r))


@query("", f"{_SCENARIOS} select document_id, scenario_id, cast(row_number() over (partition by document_id order by rank, pos) as int) as rank from l")
def scenario_level_order(r):
    return H.ranked_scenarios(_scenarios(r)).select("document_id", "scenario_id", "rank")


@query("", """p as (select c_custkey as id, case when c_custkey % 10 = 0 then null else c_custkey // 10 end as parent from customer),
  up as (select id, id as root_id, 0 as depth from p where parent is null or parent not in (select id from p) union all select p.id, up.root_id, depth + 1 from p join up on p.parent = up.id) select id as scenario_id, root_id, depth from up""", recursive=True)
def scenario_hierarchy(r):
    k = F.col("c_custkey")
    rows = r.table("customer").select(k.alias("scenario_id"), F.when(k % 10 != 0, F.floor(k / 10)).cast("long").alias("parent_id"))
    known = rows.select(F.col("scenario_id").alias("parent_id"), F.lit(True).alias("known"))
    rows = rows.join(known, "parent_id", "left").select("scenario_id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"))
    return H.hierarchy(rows)


@query("", """p as (select c_custkey as id, case when c_custkey % 41 <> 0 then c_custkey - 1 when (c_custkey // 41) % 5 = 0 then (select min(x) from (values (c_custkey + 40), ((select max(c_custkey) from customer))) as t(x)) end as parent from customer),
  k as (select id, case when parent in (select id from p) then parent end as parent from p),
  up as (select id, id as root_id, 0 as depth from k where parent is null union all select k.id, up.root_id, depth + 1 from k join up on k.parent = up.id) select k.id as scenario_id, root_id, depth from k left join up using (id)""", recursive=True)
def scenario_hierarchy_deep(r):
    """Chains of 41; in every fifth the first hangs on the last, so that it has no root."""
    k = F.col("c_custkey")
    last = r.table("customer").agg(F.max(k).alias("last"))
    first = F.when(F.floor(k / 41) % 5 == 0, F.least(k + 40, F.col("last")))
    return H.hierarchy(r.table("customer").join(F.broadcast(last)).select(k.alias("scenario_id"), F.when(k % 41 != 0, k - 1).otherwise(first).alias("parent_id")))


_NATION_DOCUMENT = """n as (select n_nationkey as k, n_name as name, ['top', 'intermediate', 'immediate'][n_nationkey % 3 + 1] as level, 't' || cast(n_nationkey % 7 as varchar) as title, 't' || cast((n_nationkey + 1) % 9 as varchar) as parent_title, n_nationkey % 3 as rank from nation)"""


@query("", f"""{_NATION_DOCUMENT}
  select 'loss' as kind, name as a, '' as b from n where lower(name) not in (select lower(n_name) from nation where n_regionkey = 1)
  union all select 'uca', 'uca-' || cast(k as varchar), case when k % 4 = 0 then '' else 'RC-' || cast(k as varchar) end from n
  union all select 'parent', 'scenario-' || cast(k as varchar), coalesce((select arg_max('scenario-' || cast(p.k as varchar), (p.rank, p.k)) from n p where p.title = n.parent_title and (p.rank, p.k) < (n.rank, n.k)), '') from n
  union all select 'link', 'scenario-' || cast(k as varchar), 'uca-' || cast(k as varchar) from n
  union all select 'missing', 'scenario-' || cast(k as varchar), cast(k + 100 as varchar) from n
  union all select 'control', 'scenario-' || cast(k as varchar), cast(k as varchar) from n where k in (select p_partkey from part)
  union all select 'node', 'n' || cast(k as varchar), name from n union all select 'node', 'n' || cast(n_nationkey + 20 as varchar), 'old' from nation where n_nationkey + 20 not in (select n_nationkey from nation)
  union all select 'edge', 'n' || cast(k as varchar), 'n' || cast(k + 1 as varchar) from n""")
def hazard_submit(r):
    """A hazard document with a loss, an action, a scenario and a node for each nation, and the tables that it makes."""
    k, text = F.col("n_nationkey"), lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    nothing = F.lit(None).cast("string")
    kinds = {
        "losses": F.struct(F.col("n_name").alias("title"), nothing.alias("description"), nothing.alias("category")),
        "findings": F.struct(F.col("n_name").alias("content"), F.when(k % 4 == 0, "").otherwise(text("RC-", k)).alias("control_code")),
        "loss_scenarios": F.struct(text("t", k % 7).alias("title"), F.get(F.array(*map(F.lit, H.LEVELS)), k % 3).alias("level"), text("t", (k + 1) % 9).alias("parent_title"), F.array(k, k + 100).alias("uca_refs"), F.array(F.struct(text("RC-", k).alias("control_code"), F.lit("mitigates").alias("relationship"))).alias("control_links")),
        "nodes": F.struct(text("n", k).alias("node_key"), F.col("n_name").alias("name")),
        "edges": F.struct(text("n", k).alias("from_key"), text("n", k + 1).alias("to_key")),
    }
    gathered = r.table("nation").agg(*[F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), x.alias("x")))), lambda e: e["x"]).alias(name) for name, x in kinds.items()])
    document = gathered.select("losses", "findings", "loss_scenarios", F.struct("nodes", "edges").alias("control_structure"))
    old = r.table("nation").select(text("n", k + 20).alias("node_key"), F.lit("old").alias("name"))
    out = H.submit(document, r.table("nation").filter("n_regionkey = 1").select(F.lower("n_name").alias("title")), r.control.select("id", "control_code"), nodes=old, repo_url="here")
    row = lambda name, kind, a, b: out[name].select(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("a"), (F.coalesce(F.col(b).cast("string"), F.lit("")) if b else F.lit("")).alias("b"))
    found = [row("losses", "loss", "title", None), row("ucas", "uca", "uca_id", "control_code"), row("scenarios", "parent", "scenario_id", "parent_id"), row("uca_links", "link", "scenario_id", "uca_id"), row("missing_refs", "missing", "scenario_id", "ref"), row("control_links", "control", "scenario_id", "control_id"), row("nodes", "node", "node_key", "name"), row("edges", "edge", "from_key", "to_key")]
    return reduce(DataFrame.unionByName, found)


@query("", """u as (select event_id as id, event_type as uca_type, case when event_id % 3 = 0 then 'design_review' else 'scan' end as source, case when event_id % 2 = 0 then 'RC-a' else 'rc-A' end as control_code, event_id % 17 as detection_count from events)
  select id, uca_type, source, detection_count from u where source = 'scan' and uca_type = 'error' and lower(control_code) = 'rc-a'""")
def ucas_filtered(r):
    return H.list_ucas(_ucas(r), source="scan", type="error", control_code="Rc-A").select("id", "uca_type", "source", "detection_count")


@query("", "select event_id as id, event_id % 17 as detection_count from events order by detection_count desc, id limit 50")
def uca_page(r):
    """The list as it is by default, which is its limit's."""
    return H.uca_page(_ucas(r)).select("id", "detection_count")


def _ucas(r):
    k = F.col("event_id")
    return r.table("events").select(k.alias("id"), F.col("event_type").alias("uca_type"), F.when(k % 3 == 0, "design_review").otherwise("scan").alias("source"), F.when(k % 2 == 0, "RC-a").otherwise("rc-A").alias("control_code"), (k % 17).alias("detection_count"))


@query("", "refs as (select c_custkey as scenario_id, unnest([cast(c_custkey % 30 as int), cast(c_custkey % 1000 as int)]) as ref from customer) select scenario_id, ref, s_suppkey as uca_id from refs left join supplier on s_suppkey = ref")
def uca_refs_resolve(r):
    k = F.col("c_custkey")
    scenarios = r.table("customer").select(k.alias("scenario_id"), F.array((k % 30).cast("int"), (k % 1000).cast("int")).alias("uca_refs"))
    return H.resolve_uca_refs(scenarios, r.table("supplier").select(F.col("s_suppkey").cast("int").alias("pos"), F.col("s_suppkey").alias("uca_id")))


@query("", "select lower(event_type) as canonical_form, count(*) as detection_count, min(event_type) as content, max(value) as confidence from events group by 1")
def uca_detection_counts(r):
    return H.detection_counts(r.table("events").select(F.col("event_type").alias("content"), F.lit("").alias("canonical_form"), F.col("value").alias("confidence")))


# --- Integrity ---------------------------------------------------------------------------------------------------

_FILES = "f as (select concat('doc/', cast(doc_id as varchar)) as path, 'sha256:' || sha256(text) as hash, doc_id from documents)"


def _files(r):
    return r.table("documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"), "doc_id", "lang")


@query("", f"""{_FILES}, m as (select path, case when doc_id % 6 = 0 then 'sha256:00' else hash end as expected from f where doc_id % 5 <> 0), a as (select path, hash as actual from f where doc_id % 7 <> 0)
  select coalesce(m.path, a.path) as path, case when actual is null then 'missing' when expected is null then 'untracked' when expected <> actual then 'mismatch' else 'ok' end as outcome from m full join a on m.path = a.path""")
def manifest_reconcile(r):
    files = _files(r)
    hashes = V.hashed(files.select("path", "content"))
    number = F.substring_index("path", "/", -1).cast("long")
    manifest = hashes.filter(number % 5 != 0).withColumn("hash", F.when(number % 6 == 0, "sha256:00").otherwise(F.col("hash")))
    return V.reconcile(manifest, hashes.filter(number % 7 != 0))


@query("", f"{_FILES} select doc_id // 100 as archive, sha256(string_agg(path || ':' || hash || chr(10), '' order by path)) as canonical_sha256 from f group by 1")
def canonical_manifest_string(r):
    files = _files(r).select(F.expr("doc_id div 100").alias("archive"), "path", S.content_hash("content").alias("hash"))
    return V.canonical_input(files, "archive").select("archive", F.sha2("canonical", 256).alias("canonical_sha256"))


# --- Scalars -----------------------------------------------------------------------------------------------------


@query("narrative", "select doc_id, uca as uca_type, 'loss of ' || source as loss_scenario, 'language ' || lang || '|length ' || cast(n_chars as varchar) as causal_factors, 'Document ' || cast(doc_id as varchar) as clean_narrative from narrative")
def narrative_parse(r):
    df = r.narrative.select("doc_id", S.parse_narrative("narrative").alias("p"))
    return df.select("doc_id", "p.uca_type", "p.loss_scenario", F.array_join("p.causal_factors", "|").alias("causal_factors"), "p.clean_narrative")


@query("", "select o_orderkey as id, case when o_orderkey % 3 = 0 then o_orderpriority end as note from orders")
def emergency_tag(r):
    message = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("fix [emergency:  "), F.col("o_orderpriority"), F.lit(" ] [emergency: no]"))).otherwise("fix [Emergency: no]")
    return r.table("orders").select(F.col("o_orderkey").alias("id"), S.emergency_note(message).alias("note"))


_VERSION = "concat(cast({0} % 3 as varchar), '.', cast({0} % 11 as varchar), '.', cast({0} % 7 as varchar), '+b', cast({0} as varchar))"


@query("", f"""v as (select p_partkey as id, case when p_partkey % 17 = 0 then 'dev-a+1' else {_VERSION.format('p_partkey')} end as a, {_VERSION.format('(p_partkey * 7 + p_size)')} as b,
  [p_partkey % 3, p_partkey % 11, p_partkey % 7] as x, [(p_partkey * 7 + p_size) % 3, (p_partkey * 7 + p_size) % 11, (p_partkey * 7 + p_size) % 7] as y from part)
  select id, split_part(a, '+', 1) as base, case when id % 17 = 0 then true else y > x end as newer from v""")
def semver_newer(r):
    def version(n):
        return F.concat_ws(".", *[(n % m).cast("string") for m in (3, 11, 7)])

    k, other = F.col("p_partkey"), F.col("p_partkey") * 7 + F.col("p_size")
    a = F.when(k % 17 == 0, "dev-a+1").otherwise(F.concat(version(k), F.lit("+b"), k.cast("string")))
    b = F.concat(version(other), F.lit("+b"), other.cast("string"))
    return r.table("part").select(k.alias("id"), S.semver_base(a).alias("base"), S.semver_newer(a, b).alias("newer"))


@query("", """select event_id as id, case when s < 60 then cast(s as varchar) || 's' when s < 3600 then cast(s // 60 as varchar) || 'm' else cast(s // 3600 as varchar) || 'h' end as delay
  from (select event_id, (event_id * 37) % 90000 as s from events)""")
def delay_format(r):
    return r.table("events").select(F.col("event_id").alias("id"), S.delay((F.col("event_id") * 37) % 90000).alias("delay"))


@query("", "select doc_id as id, case when length(text) <= 60 then replace(text, chr(10), ' ') else substr(replace(text, chr(10), ' '), 1, 57) || '...' end as short from documents")
def truncate_text(r):
    return r.table("documents").select(F.col("doc_id").alias("id"), S.truncate("text", 60).alias("short"))


@query("", f"select p_partkey as id, {_TITLE_CASE.format('x')} as title, {_TITLE_CASE.format('y')} as uca from (select p_partkey, replace(p_type, ' ', '__') || '_aB' as x, lower(replace(p_type, ' ', '_')) as y from part)")
def title_case(r):
    x, y = F.concat(F.replace("p_type", F.lit(" "), F.lit("__")), F.lit("_aB")), F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))
    return r.table("part").select(F.col("p_partkey").alias("id"), S.title_case(x).alias("title"), S.uca_title_case(y).alias("uca"))


@query("", "select o_orderkey as id, coalesce(try_cast(case when regexp_full_match(v, '[0-9]+') then v end as bigint), 0) as digits, coalesce(try_cast(nullif(regexp_extract(v, '^\\s*([+-]?\\d+)', 1), '') as int), 20) as prefix from (select o_orderkey, case o_orderkey % 4 when 0 then cast(o_orderkey * 10000000 as varchar) when 1 then cast(o_orderkey as varchar) || 'x' when 2 then 'x1' else ' -12z' end as v from orders)")
def parse_int(r):
    k = F.col("o_orderkey")
    v = F.when(k % 4 == 0, (k * 10000000).cast("string")).when(k % 4 == 1, F.concat(k.cast("string"), F.lit("x"))).when(k % 4 == 2, "x1").otherwise(" -12z")
    return r.table("orders").select(k.alias("id"), S.digits_int(v).alias("digits"), S.prefix_int(v, 20).alias("prefix"))


@query("", """select c_custkey as id, case c_custkey % 4 when 0 then '[VALIDATED]' when 1 then '[AUTO]' else '[CONTRADICTED]' end as validation, case c_custkey % 3 when 0 then '[NOT CONFIGURED]' else '[VERIFIED]' end as evidence,
  case when c_custkey % 2 = 0 then '<->' else '->' end as arrow, case c_custkey % 5 when 0 then 0.0::double when 1 then 0.25::double when 2 then 0.6::double when 3 then 1.0::double else 0.0::double end as criticality from customer""")
def badge_ladders(r):
    k = F.col("c_custkey")
    status = F.when(k % 4 == 0, "analyst_validated").when(k % 4 == 1, "auto_extracted").otherwise("contradicted")
    label = F.when(k % 5 == 0, "hobby").when(k % 5 == 1, "internal").when(k % 5 == 2, "customer-facing").when(k % 5 == 3, "critical").otherwise("other")
    return r.table("customer").select(k.alias("id"), S.validation_badge(status).alias("validation"), S.evidence_badge(F.when(k % 3 == 0, "not_configured").otherwise("verified")).alias("evidence"), S.direction_arrow(F.when(k % 2 == 0, "bidirectional").otherwise("out")).alias("arrow"), S.criticality(label).alias("criticality"))


@query("", "select c_custkey as id, 'repo' || cast(c_custkey as varchar) as name, case when c_custkey % 2 = 0 then 'b' || cast(c_custkey as varchar) else 'main' end as branch from customer")
def repository_and_ref(r):
    k = F.col("c_custkey")
    s = k.cast("string")
    remote = F.when(k % 2 == 0, F.concat(F.lit("git@host:team/repo"), s, F.lit(".git"))).when(k % 3 == 0, F.concat(F.lit("host:repo"), s)).otherwise("")
    ref = F.when(k % 2 == 0, F.concat(F.lit("refs/heads/b"), s)).otherwise("main")
    return r.table("customer").select(k.alias("id"), S.repository_name(remote, F.concat(F.lit("/home/repo"), s)).alias("name"), S.last_ref_segment(ref).alias("branch"))


@query("", r"""w as (select doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents)
  select doc_id as id, case when len(w) = 0 then '' else list_reduce(w, lambda a, x: case when length(ltrim(regexp_extract(a, '[^\n]*$'), ' ')) + 1 + length(x) <= 78 then a || ' ' || x else a || chr(10) || '  ' || x end) end as wrapped from w""")
def wrap_text(r):
    return r.table("documents").select(F.col("doc_id").alias("id"), S.wrap("text", 80, "  ").alias("wrapped"))


@query("", """select c_custkey as id, case k when 0 then 'What control is missing?' when 1 then 'What assumption is wrong?' when 2 then 'What feedback is delayed?' when 3 then 'What enforcement is bypassed?' else '' end as question
  from (select c_custkey, c_custkey % 5 as k from customer)""")
def uca_questions(r):
    k = F.col("c_custkey") % 5
    kind = F.when(k == 0, "not_provided").when(k == 1, "Providing Incorrectly").when(k == 2, "wrong_timing").when(k == 3, "Wrong_Duration").otherwise("not specified")
    return r.table("customer").select(F.col("c_custkey").alias("id"), S.uca_question(kind).alias("question"))


@query("", """select p_partkey as id, case when p_size % 5 = 0 then '' else ' (seen ' || cast(p_size % 5 as varchar) || 'x' || case when p_size % 2 = 0 then ', blast: ' || p_brand else '' end || case when p_size % 3 = 0 then ', MTTR: 2h' else '' end || ')' end as occurrences,
    case when p_size % 4 = 0 then '' else ' (effectiveness: ' || cast(p_size as varchar) || '%, applied: ' || cast(p_size % 4 as varchar) || ')' end as effectiveness,
    case when p_size % 2 = 0 then 'RC-' || cast(p_partkey as varchar) || ': ' || p_name when p_size % 3 = 0 then p_brand else p_type end as mitigation from part""")
def display_suffixes(r):
    n = F.col("p_size")
    text = lambda condition, value: F.when(condition, value).otherwise("")
    return r.table("part").select(
        F.col("p_partkey").alias("id"),
        S.occurrence_suffix(n % 5, text(n % 2 == 0, F.col("p_brand")), text(n % 3 == 0, F.lit("2h"))).alias("occurrences"),
        S.effectiveness_suffix(n % 4, n / F.lit(100.0)).alias("effectiveness"),
        S.mitigation_label(text(n % 2 == 0, F.concat(F.lit("RC-"), F.col("p_partkey").cast("string"))), F.col("p_name"), text(n % 3 == 0, F.col("p_brand")), F.col("p_type")).alias("mitigation"),
    )


@query("", """select doc_id, case when doc_id % 3 = 0 then left(content, 77) || case when length(content) > 80 then '...' else substr(content, 78) end else source end as label, case when length(p) > 80 then left(p, 77) || '...' else p end as prose,
  case when doc_id % 2 = 0 then 'about ' || lang else case when length(p) > 80 then left(p, 77) || '...' else p end end as description
  from (select doc_id, lang, source, 'of ' || repeat(source || ' ', n_chars % 30) || 'end' as p, replace(source || ' ' || repeat(lang || chr(10), n_chars % 40), chr(10), ' ') as content from documents)""")
def texts_for_display(r):
    """Labels from titles or contents, first lines of prose and descriptions of front matter, short and cut."""
    n, line = F.col("n_chars") % 30, lambda *x: F.concat(*x, F.lit("\n"))
    prose = F.concat(F.lit("of "), F.repeat(F.concat("source", F.lit(" ")), n.cast("int")), F.lit("end"))
    body = F.concat(line(F.lit("# Heading")), line(F.lit("  ")), line(F.lit("## More")), line(F.lit("  "), prose), F.lit("then"))
    front = F.concat(line(F.lit("---")), line(F.lit("name: x")), line(F.lit("description: 'about "), F.col("lang"), F.lit("'")), line(F.lit("---")), body)
    content = F.concat("source", F.lit(" "), F.repeat(line(F.col("lang")), (F.col("n_chars") % 40).cast("int")))
    return r.table("documents").select(
        "doc_id",
        S.label_or_content(F.when(F.col("doc_id") % 3 != 0, F.col("source")), content).alias("label"),
        S.first_prose_line(body).alias("prose"),
        S.front_matter_description(F.when(F.col("doc_id") % 2 == 0, front).otherwise(body)).alias("description"),
    )


@query("", """select o_orderkey as id, case o_orderkey % 3 when 0 then 'NEW' when 1 then 'UPD' else '---' end as tag, case when o_orderkey % 26 >= 20 then 'CRITICAL' when o_orderkey % 26 >= 15 then 'HIGH' when o_orderkey % 26 >= 10 then 'MEDIUM' else 'LOW' end as priority,
  case when o_orderkey % 4 = 0 then 'project' when o_orderkey % 4 = 1 then 'flag' when o_orderkey % 4 = 2 then 'project' end as service, case when o_orderkey % 5 = 0 then 'full' else 'deep' end as scan_type,
  case when length(k) > 8 then left(k, 4) || '...' || right(k, 4) else '****' end as masked, o_orderkey % 3 = 0 as inside from (select o_orderkey, 'k' || repeat('y', o_orderkey % 7) || cast(o_orderkey as varchar) as k from orders)""")
def finding_lines(r):
    """What a scan shows of findings: tags, the small scale, where names and types come from, keys, paths of archives."""
    k = F.col("o_orderkey")
    sent = F.when(k % 5 == 0, F.lit("{}")).otherwise(F.lit('{"scan_type": "deep"}'))
    rows = r.table("orders").select(k, sent.alias("value"))
    types = I.submission_fields(rows).select("o_orderkey", "scan_type")
    secret = F.concat(F.lit("k"), F.repeat(F.lit("y"), (k % 7).cast("int")), k.cast("string"))
    path = F.when(k % 3 == 0, F.concat(F.lit("/plugins/a/"), k.cast("string"))).when(k % 3 == 1, F.lit("/plugins/../etc")).otherwise(F.lit("/pluginsx/a"))
    service = I.service_name(F.when(k % 2 == 0, "project").otherwise(""), F.when(k % 4 == 1, "flag").when(k % 4 == 2, "other"))
    return types.select(k.alias("id"), S.finding_tag(F.when(k % 3 == 0, "created").when(k % 3 == 1, "updated").otherwise("unchanged")).alias("tag"), S.priority_25(k % 26).alias("priority"), service.alias("service"), "scan_type", S.masked(secret).alias("masked"), S.inside(path, "/plugins").alias("inside"))


@query("", """select s_nationkey % 3 < 2 as full_support, string_agg(s_name, ', ' order by s_name) as names, count(*) as n from supplier group by 1""")
def editor_tiers(r):
    return E.by_tier(r.table("supplier").select(F.col("s_name").alias("name"), (F.col("s_nationkey") % 3 + 1).alias("tier")))


@query("", "select l_orderkey as id, string_agg(cast(l_partkey as varchar), '>' order by l_linenumber, cast(l_partkey as varchar)) as chain from lineitem group by 1")
def pattern_causal_chains(r):
    """Chains whose steps come in any order."""
    step = F.struct(F.col("l_linenumber").alias("position"), F.col("l_partkey").cast("string").alias("label"))
    steps = r.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(step), asc=False).alias("causal_chain"))
    return K.causal_chains(steps).select("id", F.array_join(F.transform("causal_chain", lambda x: x["label"]), ">").alias("chain"))


@query("", """select o_orderkey as id, case when o_orderkey % 4 = 3 then null when o_orderkey % 4 = 1 then 'too_late' else o_orderpriority end as uca_type, case when o_orderkey % 4 = 3 then null when o_orderkey % 4 = 1 then 'loss of it' when o_orderkey % 4 = 2 then 'a loss' end as loss_scenario from orders""")
def stpa_structured_first(r):
    """Structured columns before what the narrative says, and neither where it is not parsed."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    text = F.when(k % 4 == 1, F.lit("It ran.\n**Unsafe Control Action:** too_late\n**Loss Scenario:** loss of it"))
    rows = r.table("orders").select(k.alias("id"), F.when(k % 4 == 0, F.col("o_orderpriority")).when(k % 4 == 2, F.col("o_orderpriority")).alias("uca_type"), F.when(k % 4 == 2, "a loss").alias("loss_scenario"), none.alias("_"), F.array().cast("array<string>").alias("causal_factors"), text.alias("narrative"))
    seen = R.stpa_view(rows.filter("id % 4 <> 3"), parse=True).unionByName(R.stpa_view(rows.filter("id % 4 = 3").withColumn("narrative", F.lit("**Loss Scenario:** unread")), parse=False))
    return seen.select("id", F.col("stpa.uca_type").alias("uca_type"), F.col("stpa.loss_scenario").alias("loss_scenario"))


@query("", """select o_orderkey as id, case when o_orderkey % 2 = 0 then o_orderpriority else o_orderpriority || ' ' || o_orderstatus end as arguments, o_orderkey % 3 = 0 as present from orders""")
def arguments_without_flag(r):
    k = F.col("o_orderkey")
    words = F.concat(F.when(k % 3 == 0, F.array(F.lit("--ci"))).otherwise(F.array().cast("array<string>")), F.array("o_orderpriority"), F.when(k % 2 == 1, F.array("o_orderstatus")).otherwise(F.array().cast("array<string>")), F.when(k % 6 == 0, F.array(F.lit("--ci"))).otherwise(F.array().cast("array<string>")))
    return r.table("orders").select(k.alias("id"), I.without_flag(words, "--ci").alias("a")).select("id", F.array_join("a.arguments", " ").alias("arguments"), "a.present")


@query("risk fact", """f as (select r.id as risk_id, f.id, f.confidence as score, f.technology from risk r join fact f on f.id = r.service_id % 50)
  select risk_code, coalesce(string_agg(cast(f.id as varchar) || ':' || technology, ',' order by f.score desc, f.id), '') as facts from risk r left join f on f.risk_id = r.id group by risk_code""")
def risk_context_facts(r):
    """The facts section of each risk."""
    facts = r.risk.select(F.col("id").alias("risk_id"), (F.col("service_id") % 50).alias("id")).join(r.fact.select("id", F.col("confidence").alias("score"), "technology"), "id")
    df = R.context(r.risk, r.risk_control, r.control, r.evidence, facts=facts)
    return df.select("risk_code", F.array_join(F.transform("facts", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["technology"])), ",").alias("facts"))


@query("pattern", "select id, occurrence_count from pattern where starts_with(id, 'R') and occurrence_count >= 40")
def patterns_by_type(r):
    return K.patterns(r.pattern.withColumn("pattern_type", F.substring("id", 1, 1)), type="R", min_occurrences=40).select("id", "occurrence_count")


@query("risk", """select '{"risk_code":"' || risk_code || '","score":' || cast(score as varchar) || '}' as json from risk where status = 'detected' order by score desc, id limit 100""")
def risk_json_limited(r):
    """The list's first hundred, as JSON: the limit is the list's."""
    return sinks.limited_json(R.list_risks(r.risk, status="detected").join(r.risk.select("risk_code", "id"), "risk_code").select("risk_code", "score", "id"), [F.desc("score"), F.col("id")], 100).select(F.regexp_replace("json", ',"id":[0-9]+', "").alias("json"))


@query("evidence", """select control_id, type, 'given' as name, case when l_orderkey % 2 = 0 then 'abc' || cast(l_orderkey as varchar) else 'head' end as git_hash, 'configured' as status from (select l_orderkey, l_partkey as control_id, l_linestatus as type from lineitem where l_linenumber = 2 and l_orderkey % 3 <> 0)
  union all select control_id, type, 'old', null, status from evidence""")
def evidence_submitted(r):
    """Evidence with what was submitted: without a type it is left out, without a commit it gets the scan's."""
    k = F.col("l_orderkey")
    new = r.table("lineitem").filter("l_linenumber = 2").select(F.col("l_partkey").alias("control_id"), F.when(k % 3 != 0, F.col("l_linestatus")).alias("type"), F.lit("given").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("abc"), k.cast("string"))).alias("git_hash"))
    old = r.evidence.select("control_id", "type", F.lit("old").alias("name"), F.lit(None).cast("string").alias("git_hash"), "status")
    return C.submit_evidence(old, new, "head")


@query("page_path", "select path, count(*) as n from page_path where page_id % 4 <> 0 group by path")
def changed_paths(r):
    """Lists of changed files with blank lines in them."""
    return I.changed_files(r.page_path.select(F.when(F.col("page_id") % 4 == 0, F.lit(" \t")).otherwise(F.col("path")).alias("value"))).groupBy(F.col("value").alias("path")).agg(F.count(F.lit(1)).alias("n"))


# --- Tables kept by key, sinks, discovery --------------------------------------------------------------------------


@query("", "select concat('e', cast(s_suppkey as varchar)) as editor, case when s_suppkey % 3 = 0 then '2.0.0' else '1.0.0' end as version from supplier where s_suppkey <> 5 union all select concat('new', cast(n_nationkey as varchar)), '2.0.0' from nation")
def plugin_upsert_delete(r):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("e"), k.cast("string"))
    installs = r.table("supplier").select(name.alias("editor"), F.lit("1.0.0").alias("version"))
    new = r.table("supplier").filter(k % 3 == 0).select(name.alias("editor"), F.lit("2.0.0").alias("version"))
    new = new.unionByName(r.table("nation").select(F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("editor"), F.lit("2.0.0").alias("version")))
    return E.remove_install(E.record_install(installs, new), "e5")


@query("risk", """select id, case when id % 7 = 0 then 'accepted' else status end as status from risk where id % 11 <> 0 union all select -n_nationkey - 1, 'new' from nation""")
def keyed_buckets(r):
    """A register in buckets by id after an upsert and a deletion that each touch a part of it."""
    path = f"{shared_folder(r.spark)}/register-{uuid.uuid4().hex}"
    own = r.risk.select("id", "status")
    sinks.upsert_keyed(own, path, ["id"])
    new = own.filter("id % 7 = 0").withColumn("status", F.lit("accepted")).unionByName(r.table("nation").select((-F.col("n_nationkey") - 1).alias("id"), F.lit("new").alias("status")))
    sinks.upsert_keyed(new, path, ["id"])
    sinks.delete_keyed(own.filter("id % 11 = 0").select("id"), path, own.schema)
    return sinks.read_keyed(r.spark, path, own.schema)


@query("", """select concat('e', cast(s_suppkey as varchar)) as editor, case when s_suppkey % 2 = 0 then cast(null as varchar) when s_suppkey % 3 = 0 then '1.5.0' else '1.4.9+x' end as version,
  case when s_suppkey % 2 = 0 then 'new' when s_suppkey % 3 = 0 then 'current' else 'update' end as outcome from supplier""")
def install_states(r):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("e"), k.cast("string"))
    installs = r.table("supplier").filter(k % 2 != 0).select(name.alias("editor"), F.when(k % 3 == 0, "1.5.0").otherwise("1.4.9+x").alias("version"))
    return E.install_state(r.table("supplier").select(name.alias("editor")), installs, "1.5.0")


@query("risk", "select rpad(risk_code, 12, ' ') || ' ' || rpad(status, 10, ' ') || ' ' || rpad(cast(score as varchar), 5, ' ') || ' ' || category as line from risk")
def risk_table_lines(r):
    return sinks.fixed_width(r.risk, {"risk_code": 12, "status": 10, "score": 5, "category": 0})


@query("risk", """select '{"risk_code":"' || risk_code || '"' || case when score = 0 then '' else ',"score":' || cast(score as varchar) end || '}' as json from risk""")
def risk_json_lines(r):
    return sinks.json_lines(r.risk.select("risk_code", "score"), omit_zero=["score"])


@query("", """select concat('r', cast(c_nationkey as varchar)) as repo, concat('c', cast(c_custkey % 20 as varchar)) as name, concat(case min(c_custkey % 2) when 0 then 'services/' else 'apps/' end, concat('c', cast(c_custkey % 20 as varchar)), '/') as path, 20 as phase
  from customer group by c_nationkey, c_custkey % 20 union all select concat('r', cast(c_nationkey as varchar)), 'main', 'cmd/main/', 30 from customer group by c_nationkey""")
def component_discovery(r):
    k = F.col("c_custkey")
    base = r.table("customer").select(F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("repo"), k)
    built = base.select("repo", F.concat(F.when(k % 2 == 0, "services/c").otherwise("apps/c"), (k % 20).cast("string"), F.lit("/go.mod")).alias("path"))
    files = built.unionByName(base.select("repo", F.lit("cmd/main/main.go").alias("path"))).unionByName(base.select("repo", F.lit("vendor/Dockerfile").alias("path"))).distinct().withColumn("content", F.lit(None).cast("string"))
    return D.components(files)


@query("", """n as (select 'r' || cast(n_nationkey as varchar) as repo, cast(n_nationkey as varchar) as k, n_nationkey % 2 = 0 as even from nation)
  select repo, unnest(['svc' || k, 'crate' || k, 'w' || k, 'mod' || k, 'core', 'App' || k, 'd' || k, 'api' || k, 'run' || k, 'app' || k, 'tool' || k]) as name,
    unnest(['svc' || k || '/', 'crate' || k || '/', 'web/w' || k || '/', 'mod' || k || '/', 'lib' || k || '/core/', 'src/App' || k || '/', 'dart/d' || k || '/', 'services/api' || k || '/', 'cmd/run' || k || '/', '.', 'tool' || k || '/']) as path,
    unnest([10, 11, 12, 13, 14, 15, 16, 20, 30, 31, 40]) as phase from n where even
  union all select repo, 'project' || k, '.', 50 from n where not even""")
def workspace_components(r):
    """A repository for each nation: every second one has a component of each phase, the others fall back to the project."""
    key = F.col("n_nationkey")
    k = key.cast("string")
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    files = [
        (F.lit("go.work"), of("go 1.22\nuse ./svc", k, "\n")),
        (F.lit("Cargo.toml"), of('[workspace]\nmembers = [\n"crate', k, '",\n"gone"\n]\n')),
        (F.lit("package.json"), F.lit('{"workspaces": ["web/*"]}')),
        (F.lit("pom.xml"), of("<modules><module>mod", k, "</module><module>gone</module></modules>")),
        (F.lit("settings.gradle"), of("include ':lib", k, ":core', ':gone'\n")),
        (F.lit("all.sln"), of('Project("{1}") = "App", "src\\App', k, "\\App", k, '.csproj", "{2}"\n')),
        (F.lit("melos.yaml"), F.lit("name: all\npackages:\n  - dart/*\nscripts:\n  - other/*\n")),
        (F.lit("pubspec.yaml"), of("name: app", k, "\n")),
        *[(path, F.lit(None).cast("string")) for path in (of("crate", k, "/src.rs"), of("web/w", k, "/index.js"), F.lit("web/readme"), of("mod", k, "/a"), of("lib", k, "/core/a"), of("src/App", k, "/App", k, ".csproj"), of("dart/d", k, "/pubspec.yaml"), F.lit("dart/none/readme"), of("services/api", k, "/go.mod"), of("services/doc", k, "/readme"), of("cmd/run", k, "/main.go"), F.lit("lib/main.dart"), of("tool", k, "/Dockerfile"), F.lit("vendor/Dockerfile"))],
    ]
    repo = of("r", k)
    trees = r.table("nation").filter(key % 2 == 0).select(repo.alias("repo"), F.inline(F.array(*[F.struct(p.alias("path"), c.alias("content")) for p, c in files])))
    return D.with_fallback(D.components(trees), r.table("nation").select(repo.alias("repo"), of("project", k).alias("project")))


_ROOT_FILES = {"go.work": "Go", "build.gradle.kts": "Java", "Pipfile": "Python", "Cargo.toml": "Rust", "Gemfile": "Ruby", "package.json": "JavaScript", "tsconfig.json": "TypeScript", "a.sln": "C#", "CMakeLists.txt": "C/C++", "composer.json": "PHP", "mix.exs": "Elixir", "build.sbt": "Scala", "pubspec.yaml": "Dart", "lib/x.gemspec": "Ruby", "src/x.csproj": "C#", "a/b/x.csproj": None, "sub/go.mod": None, "notes.txt": None}


@query("", f"""f(i, language) as (values {', '.join(f"({i}, {repr(v) if v else 'null'})" for i, v in enumerate(_ROOT_FILES.values()))})
  select distinct 'r' || cast(c_nationkey as varchar) as repo, language from customer join f on i = c_custkey % {len(_ROOT_FILES)} where language is not null""")
def root_languages(r):
    names = F.array(*map(F.lit, _ROOT_FILES))
    files = r.table("customer").select(F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("repo"), F.get(names, (F.col("c_custkey") % len(_ROOT_FILES)).cast("int")).alias("path"))
    return D.languages(files)


# --- Extensions ----------------------------------------------------------------------------------------------------


@query("incident", "select date_trunc('day', ts) as window_start, severity, count(*) as n, max(value) as max_value from incident group by all")
def incident_windows(r):
    """Extension: the streaming operator's windows, over the table."""
    return streams.windowed_history(streams.incidents(r.table("events"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("risk", "select status, category, count(*) as n, cast(sum(score) as bigint) as score from risk group by grouping sets ((status, category), (status), ())")
def risk_cube(r):
    """Extension: roll-up over status and category."""
    return r.risk.rollup("status", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
