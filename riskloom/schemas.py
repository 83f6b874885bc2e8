"""Spark schemas of the warehouse's tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "meta": "key string, value string",
    "commits": "sha string, parents array<string>, message string, author string, email string, ts timestamp, files array<struct<path:string,additions:int,deletions:int,renamed_from:string>>, functions array<string>, additions int, deletions int, is_fix boolean, issues array<int>",
    "commit_files": "sha string, file string, additions int, deletions int, author string, ts timestamp",
    "commit_functions": "sha string, unit string, ts timestamp",
    "issues": "number int, title string, body string, labels array<string>, state string, author string, comments array<string>, linked_prs array<int>, created_at timestamp, closed_at timestamp",
    "prs": "number int, title string, body string, author string, reviews array<string>, linked_issues array<int>, merge_sha string, merged_at timestamp",
    "szz_links": "fix_sha string, introducing_sha string, file string, function string, line int, confidence double, issue int",
    "coverage": "file string, line int, test_id string",
    "tests": "test_id string, file string, duration double, outcome string",
    "runs": "run_id string, pr int, head_sha string, base_sha string, decision string, risk double, tokens int, latency double, created_at double, payload string",
    "claims": "claim_id string, run_id string, agent string, type string, target string, assertion string, reason string, evidence_ids array<string>",
    "verdicts": "claim_id string, run_id string, status string, method string, evidence array<string>, detail string",
    "llm_cache": "key string, payload string",
    "events": "schema string, id string, run_id string, seq int, ts double, stage string, kind string, status string, message string, data string",
    "nodes": "id string, kind string, path string, qualname string, name string, start int, end int, signature string, is_test boolean",
    "edges": "src string, dst string, type string, confidence double, fix string, issue int",
    "snapshots": "version string, t double, requests long, errors long, p95_ms double, mean_ms double",
    "students": "id string, name string, email string, program string, year int, admitted_on date, status string, scholarship_pct int, is_international boolean",
    "courses": "code string, title string, credits int, department string, level int, prerequisites array<string>, capacity int, slot string, lab boolean",
    "enrollments": "student_id string, course_code string, term string, status string, grade string, enrolled_on date",
    "attendance": "student_id string, course_code string, session_date date, present boolean, excused boolean",
    "invoices": "id string, student_id string, term string, issued_on date, due_date date, items map<string,decimal(12,2)>",
    "payments": "invoice_id string, amount decimal(12,2), paid_on date",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def names() -> list[str]:
    return list(_DDL)
