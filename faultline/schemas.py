"""Explicit schemas of the logical relations and of the documents that the engine reads, as DDL (no session is needed to import them)."""

from __future__ import annotations

_RISK = "id string, risk_code string, title string, category string, score int, status string, linked_services array<string>, control_codes array<string>, stale_since string, last_seen_at string, resolved_at string, uca_type string, causal_factors array<string>, loss_scenario string"
_CONTROL = "id string, control_code string, name string, category string, type string, objective string, description string, risk_statement string, test_description string, remediation string, expected_evidence_types array<string>, treatment string, weight int, implementation string, risk_codes array<string>"
_EVIDENCE = "id string, control_id string, type string, name string, url_or_identifier string, description string, git_hash string, status string, verified_at string, created_at string"
_FACT = "id string, content string, vertical string, fact_type string, technologies array<string>, services array<string>, confidence double, validation_status string, validation_count int, score double"
_PROCEDURE = "id string, title string, description string, vertical string, procedure_type string, related_controls array<string>, technologies array<string>, effectiveness_score double, applied_count int, success_count int, confidence double, score double"
_PATTERN = "id string, title string, description string, pattern_type string, vertical string, occurrence_count int, typical_blast_radius string, typical_mttr string, related_controls array<string>, prevention_strategies array<string>, mitigation_steps array<string>, confidence double, score double, causal_chain array<struct<order:int,event:string,typical_delay:string>>, trigger_event string"
_EDGE = "id string, relation_type string, source_type string, source_id string, source_label string, target_type string, target_id string, target_label string, strength double, direction string, evidence array<string>, observation_count int"
_HIT = "type string, id string, title string, content string, vertical string, score double, confidence double"
_GRAPH_HIT = "type string, id string, title string, content string, vertical string, similarity double, confidence double, discovery_method string, graph_path string"
_TRAVERSAL = "entity_type string, entity_id string, entity_label string, relation_type string, strength double, depth int"
_IMPACT = "chain array<struct<entity_type:string,entity_id:string,label:string,relation_type:string,delay_seconds:int,strength:double,depth:int>>, total_strength double, mitigations array<struct<for_node_id:string,control_code:string,control_name:string,procedure_title:string,entity_label:string>>"
_COMPONENT = "name string, path string"
_SCAN_COMPONENT = "name string, path string, type string, description string, technologies array<string>"
_DEPENDENCY = "target string, type string, criticality string, description string, source string"
_SCAN = "service string, scan_type string, scan_mode string, findings array<variant>, metadata struct<git_commit:string,git_branch:string,scanner_id:string,skill_name:string,skill_version:string,skill_checksum:string>, components array<struct<name:string,path:string,type:string,description:string,technologies:array<string>>>, dependencies array<struct<target:string,type:string,criticality:string,description:string,source:string>>, business_criticality double"
_HAZARD = "losses array<struct<title:string,description:string,category:string>>, findings array<struct<content:string,uca_type:string,causal_factors:array<string>,loss_scenario:string,canonical_form:string,confidence:double,control_code:string,loss_title:string,loss_category:string,estimated_fix_complexity:string,constraint_type:string>>, loss_scenarios array<struct<title:string,description:string,level:string,parent_title:string,uca_refs:array<int>,control_links:array<struct<control_code:string,relationship:string>>>>, control_structure struct<nodes:array<struct<node_key:string,name:string,hierarchy_level:string,source:string,confidence:int,description:string>>,edges:array<struct<from_key:string,to_key:string,label:string,edge_type:string,source:string,confidence:int>>>"
_MANIFEST = "version string, signed_at string, algorithm string, key_id string, files map<string,string>, signature string, provenance struct<commit_sha:string,build_job:string,builder:string>"

SCHEMAS: dict[str, str] = {
    "risk": _RISK,
    "risk_detail": f"{_RISK}, mapped_controls array<struct<control_code:string,name:string,description:string,category:string,type:string,objective:string>>, narrative string",
    "mapped_control": "control_code string, name string, description string, category string, type string, objective string",
    "incident_history": "total_incidents long, last_30_days long, last_90_days long, critical_count long, high_count long, most_recent_title string, average_mttr string",
    "score_factor": "description string, points int, source string",
    "control": _CONTROL,
    "evidence": _EVIDENCE,
    "fact": _FACT,
    "procedure": _PROCEDURE,
    "pattern": _PATTERN,
    "knowledge_health": "total_facts long, total_procedures long, total_patterns long, validated_percentage double, avg_confidence double, stale_count long, contradiction_count long",
    "relationship": _EDGE,
    "traversal_node": _TRAVERSAL,
    "impact_path": _IMPACT,
    "impact_metadata": "traversal_depth int, edges_examined long, query_time_ms long",
    "search_hit": _HIT,
    "graph_search_hit": _GRAPH_HIT,
    "scan_request": _SCAN,
    "scan_summary": "total long, created long, updated long, unchanged long, critical long, high long, medium long, low long",
    "uca_coverage": "discovered int, analyzed int, cap int, ucas_generated int, ucas_stored int",
    "review_risk": "id string, risk_code string, title string, score int, status string",
    "review_response": "decision string, message string, blocking_risks array<struct<id:string,risk_code:string,title:string,score:int,status:string>>, risk_summary struct<total:long,critical:long,high:long,medium:long,low:long>, deep_link string, emergency_used boolean, emergency_note string",
    "hazard_document": _HAZARD,
    "cs_node": "node_key string, name string, hierarchy_level string, source string, confidence int, description string",
    "cs_edge": "from_key string, to_key string, label string, edge_type string, source string, confidence int",
    "uca": "id string, content string, uca_type string, source string, control_code string, detection_count long, confidence double, validation_status string, causal_factors array<string>",
    "component": _COMPONENT,
    "scan_component": _SCAN_COMPONENT,
    "dependency": _DEPENDENCY,
    "project_config": "project string, criticality string, components array<struct<name:string,path:string>>",
    "integrity_manifest": _MANIFEST,
    "plugin_install": "editor string, version string, installed string, location string",
    "editor": "name string, display_name string, binary string, tier int",
    "skill": "name string, filename string, content string, checksum string",
}


def empty(spark, name: str):
    """An empty relation of a catalogued schema."""
    return spark.createDataFrame([], SCHEMAS[name])
