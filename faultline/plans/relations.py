"""The logical relations as views of the tables of a folder: DataFrames, and the same views as SQL for the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.documents import table
from faultline.sources.scratch import dealt, partitions_of


class Relations:
    """Relations over ``sf_dir``; each is built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def risk(self) -> DataFrame:
        priority = F.col("o_orderpriority")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("R-"), F.col("o_orderkey").cast("string")).alias("risk_code"),
            F.concat(priority, F.lit(" order "), F.col("o_orderkey").cast("string")).alias("title"),
            F.lower(F.replace(F.substr(priority, F.lit(3)), F.lit(" "), F.lit("_"))).alias("category"),
            F.floor(F.col("o_totalprice") / F.lit(5000.0)).cast("int").alias("score"),
            F.when(F.col("o_orderstatus") == "O", "detected").when(F.col("o_orderstatus") == "F", "resolved").otherwise("accepted").alias("status"),
            F.col("o_custkey").alias("service_id"),
            F.col("o_orderdate").alias("last_seen_at"),
        )

    @cached_property
    def control(self) -> DataFrame:
        kind = F.col("p_partkey") % 3
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("RC-"), F.col("p_partkey").cast("string")).alias("control_code"),
            F.col("p_name").alias("name"),
            F.lower("p_type").alias("category"),
            F.when(kind == 0, "preventive").when(kind == 1, "detective").otherwise("corrective").alias("type"),
            (F.col("p_size") % 10 + 1).cast("int").alias("weight"),
        )

    @cached_property
    def risk_control(self) -> DataFrame:
        pairs = self.table("lineitem").select(F.col("l_orderkey").alias("risk_id"), F.col("l_partkey").alias("control_id"))
        return dealt(pairs, partitions_of(pairs), "risk_id", "control_id").distinct()

    @cached_property
    def evidence(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self.table("lineitem").filter("l_linenumber = 1").select(
            F.col("l_orderkey").alias("risk_id"),
            F.col("l_partkey").alias("control_id"),
            F.when(flag == "A", "test").when(flag == "N", "code").otherwise("document").alias("type"),
            F.when(F.col("l_linestatus") == "F", "verified").otherwise("configured").alias("status"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def incident(self) -> DataFrame:
        severity = F.when(F.col("value") >= 300, "critical").when(F.col("value") >= 100, "high").otherwise("other")
        return self.table("events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").alias("service_id"), "ts", "value", severity.alias("severity"), F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("title"))

    @cached_property
    def fact(self) -> DataFrame:
        quality = F.col("quality")
        d = self.table("documents").join(self.table("labels"), "doc_id", "left")
        return d.select(
            F.col("doc_id").alias("id"),
            F.col("text").alias("content"),
            F.col("lang").alias("vertical"),
            F.col("source").alias("technology"),
            F.when(quality == 1, "analyst_validated").when(quality == 0, "contradicted").otherwise("auto_extracted").alias("validation_status"),
            F.when(quality == 1, 0.9).when(quality == 0, 0.2).otherwise(0.5).alias("confidence"),
        )

    @cached_property
    def _parts_shipped(self) -> DataFrame:
        return self.table("lineitem").select("l_partkey", "l_returnflag", "l_linestatus").join(self.table("part"), F.col("p_partkey") == F.col("l_partkey"))

    @cached_property
    def procedure(self) -> DataFrame:
        """id, applied_count, success_count and related_controls (sorted)."""
        stats = self._parts_shipped.groupBy(F.col("p_brand").alias("id")).agg(F.count(F.lit(1)).alias("applied_count"), F.count_if(F.col("l_returnflag") != "R").alias("success_count"))
        own = self.table("part").groupBy(F.col("p_brand").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("RC-"), F.col("p_partkey").cast("string")))).alias("related_controls"))
        return stats.join(own, "id")

    @cached_property
    def pattern(self) -> DataFrame:
        return self._parts_shipped.groupBy("l_returnflag", "l_linestatus", "p_type").agg(F.count(F.lit(1)).alias("occurrence_count")).select(F.concat("l_returnflag", "l_linestatus", F.lit("-"), "p_type").alias("id"), F.col("p_type").alias("vertical"), "occurrence_count")

    @cached_property
    def edge(self) -> DataFrame:
        def key(kind, column):
            return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))

        def edges(df, source, source_key, target, target_key, relation, strength):
            return df.select(F.lit(source).alias("source_type"), key(source, source_key).alias("source_id"), F.lit(target).alias("target_type"), key(target, target_key).alias("target_id"), F.lit(relation).alias("relation_type"), strength.cast("double").alias("strength"))

        supplied = self.table("lineitem").groupBy("l_suppkey", "l_partkey").agg((F.max("l_quantity") / F.lit(50.0)).alias("s"))
        return (
            edges(self.table("nation"), "region", "n_regionkey", "nation", "n_nationkey", "contains", F.lit(1.0))
            .unionByName(edges(self.table("supplier"), "nation", "s_nationkey", "supplier", "s_suppkey", "depends_on", F.lit(0.9)))
            .unionByName(edges(supplied, "supplier", "l_suppkey", "part", "l_partkey", "causes", F.col("s")))
        )

    @cached_property
    def page_path(self) -> DataFrame:
        return self.table("pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))

    @cached_property
    def component(self) -> DataFrame:
        return self.spark.createDataFrame([("english", "/en/"), ("english-1xx", "/en/1"), ("french", "/fr/"), ("german", "/de/")], "name string, path string")

    @cached_property
    def narrative(self) -> DataFrame:
        kind = F.col("doc_id") % 4
        uca = F.when(kind == 0, "not_provided").when(kind == 1, "providing_incorrectly").when(kind == 2, "wrong_timing").otherwise("wrong_duration")
        parts = [F.lit("Document "), F.col("doc_id").cast("string"), F.lit("\n**Unsafe Control Action:** "), uca, F.lit("\n**Loss Scenario:** loss of "), F.col("source"), F.lit("\n**Causal Factors:**\n- language "), F.col("lang"), F.lit("\n  - length "), F.col("n_chars").cast("string")]
        return self.table("documents").select("doc_id", "source", "lang", "n_chars", F.concat(*parts).alias("narrative"))


#: The views as SQL that DuckDB reads, for the oracle alone.
VIEWS = {
    "risk": """select o_orderkey as id, concat('R-', cast(o_orderkey as varchar)) as risk_code, concat(o_orderpriority, ' order ', cast(o_orderkey as varchar)) as title,
      lower(replace(substr(o_orderpriority, 3), ' ', '_')) as category, cast(floor(o_totalprice / cast(5000 as double)) as int) as score,
      case o_orderstatus when 'O' then 'detected' when 'F' then 'resolved' else 'accepted' end as status, o_custkey as service_id, o_orderdate as last_seen_at from orders""",
    "control": """select p_partkey as id, concat('RC-', cast(p_partkey as varchar)) as control_code, p_name as name, lower(p_type) as category,
      case p_partkey % 3 when 0 then 'preventive' when 1 then 'detective' else 'corrective' end as type, cast((p_size % 10) + 1 as int) as weight from part""",
    "risk_control": "select distinct l_orderkey as risk_id, l_partkey as control_id from lineitem",
    "evidence": """select l_orderkey as risk_id, l_partkey as control_id, case l_returnflag when 'A' then 'test' when 'N' then 'code' else 'document' end as type,
      case l_linestatus when 'F' then 'verified' else 'configured' end as status, l_shipdate as created_at from lineitem where l_linenumber = 1""",
    "incident": """select event_id as id, user_id as service_id, ts, value, case when value >= cast(300 as double) then 'critical' when value >= cast(100 as double) then 'high' else 'other' end as severity, concat(event_type, ' ', cast(event_id as varchar)) as title
      from events where event_type = 'error'""",
    "fact": """select d.doc_id as id, d.text as content, d.lang as vertical, d.source as technology,
      case when l.quality = 1 then 'analyst_validated' when l.quality = 0 then 'contradicted' else 'auto_extracted' end as validation_status,
      cast(case when l.quality = 1 then 0.9 when l.quality = 0 then 0.2 else 0.5 end as double) as confidence from documents d left join labels l on l.doc_id = d.doc_id""",
    "procedure_stats": """select p_brand as id, count(*) as applied_count, cast(sum(case when l_returnflag <> 'R' then 1 else 0 end) as bigint) as success_count
      from lineitem join part on p_partkey = l_partkey group by p_brand""",
    "procedure_control": "select distinct p_brand as procedure_id, concat('RC-', cast(p_partkey as varchar)) as control_code from part",
    "pattern": """select concat(l_returnflag, l_linestatus, '-', p_type) as id, p_type as vertical, count(*) as occurrence_count
      from lineitem join part on p_partkey = l_partkey group by l_returnflag, l_linestatus, p_type""",
    "edge": """select 'region' as source_type, concat('region:', cast(n_regionkey as varchar)) as source_id, 'nation' as target_type, concat('nation:', cast(n_nationkey as varchar)) as target_id,
      'contains' as relation_type, cast(1 as double) as strength from nation
      union all select 'nation', concat('nation:', cast(s_nationkey as varchar)), 'supplier', concat('supplier:', cast(s_suppkey as varchar)), 'depends_on', cast(0.9 as double) from supplier
      union all select 'supplier', concat('supplier:', cast(l_suppkey as varchar)), 'part', concat('part:', cast(l_partkey as varchar)), 'causes', max(l_quantity) / cast(50 as double) from lineitem group by l_suppkey, l_partkey""",
    "page_path": "select page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) as path from pages",
    "component": "select 'english' as name, '/en/' as path union all select 'english-1xx', '/en/1' union all select 'french', '/fr/' union all select 'german', '/de/'",
    "narrative": """select doc_id, source, lang, n_chars, case doc_id % 4 when 0 then 'not_provided' when 1 then 'providing_incorrectly' when 2 then 'wrong_timing' else 'wrong_duration' end as uca,
      concat('Document ', cast(doc_id as varchar), chr(10), '**Unsafe Control Action:** ', case doc_id % 4 when 0 then 'not_provided' when 1 then 'providing_incorrectly' when 2 then 'wrong_timing' else 'wrong_duration' end,
      chr(10), '**Loss Scenario:** loss of ', source, chr(10), '**Causal Factors:**', chr(10), '- language ', lang, chr(10), '  - length ', cast(n_chars as varchar)) as narrative from documents""",
    "priority": "select id as pid, case when score >= 80 then 'CRITICAL' when score >= 60 then 'HIGH' when score >= 40 then 'MEDIUM' else 'LOW' end as priority from risk",
}


def with_views(names: str, sql: str, recursive: bool = False) -> str:
    """``sql`` after the named views (separated by blanks), which may use earlier ones."""
    body = ", ".join(f"{n} as ({VIEWS[n]})" for n in names.split())
    if sql.lstrip().startswith("select"):
        return f"with {body} {sql}" if body else sql
    return f"with {'recursive ' if recursive else ''}{', '.join(filter(None, [body, sql]))}"
