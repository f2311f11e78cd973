"""Explicit schemas of every table the library reads; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "nodes": """id string, kind string, name string, qualified_name string, file_path string, language string,
        start_line int, end_line int, start_column int, end_column int, docstring string, signature string,
        visibility string, is_exported boolean, is_async boolean, is_static boolean, is_abstract boolean,
        decorators array<string>, type_parameters array<string>, updated_at timestamp""",
    "edges": """id bigint, source string, target string, kind string, metadata map<string,string>,
        line int, col int, provenance string""",
    "files": """path string, content_hash string, language string, size bigint, modified_at timestamp,
        indexed_at timestamp, node_count int, errors string""",
    "finding": """chain_id string, endpoint string, endpoint_fqn string, fqn string, method_name string,
        mode string, vuln_type string, vuln_subtype string, severity string, confidence double,
        evidence array<string>, summary string,
        chain array<struct<fqn:string,depth:int,node_type:string>>,
        judgment struct<D1_sink:string,D1_sanitizer_effective:boolean,D2_auth_state:string,
            D3_business_rule:string,D3_missing_rule:string,D4_data_classification:string,D5_state_change:boolean>,
        business_impact string, prerequisites array<string>, poc_payload string, poc_status string,
        poc_attempts array<struct<payload:string,result:string,root_cause:string>>,
        status string, score int, tags array<string>, similar_to_fp string""",
    "runtime_finding": """findings array<struct<id:string,title:string,category:string,severity:string,
        confidence:string,status:string,static_reference:string,
        taint_flow:struct<source:string,sink:string,intermediate_calls:array<string>,taint_transforms:array<string>>,
        runtime_target:struct<class_name:string,method_name:string>,
        evidence:array<struct<id:string,command:string,output_excerpt:string,duration_ms:bigint,
            request_headers:map<string,string>,call_stack:array<string>>>>>""",
    "pruning": """ts timestamp, level string, rule_id string, endpoint_fqn string, chain_id string, reason string,
        reversible boolean, fwd_modes_skipped array<string>, fwd_modes_kept array<string>, node_idx int,
        evidence string, skipped_redo boolean""",
    "failures": """ts timestamp, role string, endpoint_fqn string, chain_id string, attempt int,
        failure_type string, duration_sec int, error string""",
    "transcript": """_type string, session_id string, started_at timestamp, started_at_ms bigint,
        ended_at timestamp, ended_at_ms bigint, ts timestamp, ts_ms bigint, phase string, step string,
        command string, status string, exit_code int, output string, phases_completed array<string>,
        total_duration_ms bigint, log_entries bigint""",
    "rounds": """round int, ts timestamp, elapsed double, rc int, n_hi int, n_lo int, n_poc int,
        total_reports int, ep_lines int, p54_pass boolean, poc_consistent boolean, n_redis_audit_keys bigint""",
    "kv": """group_id string, commit_hash string, kind string, entity string, sub string, value string,
        written_at timestamp, ttl_s bigint""",
    "matches": """text string, file string, lines string, language string, ruleId string, severity string,
        range struct<byteOffset:struct<start:int,`end`:int>,start:struct<line:int,column:int>,
            `end`:struct<line:int,column:int>>,
        metaVariables struct<single:map<string,struct<text:string>>,
            multi:map<string,array<struct<text:string>>>>,
        labels array<struct<text:string>>""",
    "preset": """project struct<groupId:string,artifactId:string>, framework struct<primary:string>,
        annotations struct<custom:array<struct<name:string,auth_equivalent:string>>,framework_loaded:array<string>>,
        framework_skip_packages array<string>, tech_stack_vuln_whitelist map<string,array<string>>""",
    "sessions": """id string, title string, time_created bigint, tokens_input bigint, tokens_output bigint,
        cost double""",
    "parts": "id string, session_id string, type string, data string, time_created bigint",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])
