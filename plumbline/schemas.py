"""Table schemas of the audit store, as DDL."""

from __future__ import annotations

AUDITS = (
    "id string, input string, bias_score double, truth_score double, trust_score double, "
    "corrected string, audit_type string, model_name string, prompt string, "
    "report_json string, column_mapping string, created_at timestamp"
)
REVIEWS = (
    "id bigint, audit_id string, trust_score double, input_preview string, status string, "
    "reviewer_notes string, created_at timestamp, reviewed_at timestamp"
)
FEEDBACK = (
    "id bigint, audit_id string, correct boolean, bias_flag boolean, notes string, "
    "timestamp timestamp"
)
ISSUES = (
    "id bigint, audit_id string, issue string, severity string, resolved boolean, "
    "timestamp timestamp"
)
ARTICLES = "id bigint, title string, content string, source string"
MATRIX = (
    "features array<array<double>>, labels array<double>, feature_names array<string>, "
    "protected_index int"
)
CITATION = "struct<title:string,source:string,similarity:double,snippet:string>"
REPORT = (
    "audit_id string, audit_type string, trust_score double, input_text string, "
    "corrections string, elapsed_seconds double, requires_human_review boolean, "
    "bias struct<bias_score:double,demographic_parity:double,equal_opportunity:double,"
    "feature_importance:map<string,double>>, "
    "truth struct<truth_score:double,groundedness:double,"
    "citations:array<struct<title:string,source:string,similarity:double,snippet:string,"
    "source_text:string>>,"
    "claim_citations:array<struct<claim:string,verdict:string,source_text:string>>>, "
    "cluster struct<cluster_fairness:double>, "
    "distribution struct<distribution_stability:double>, "
    "regulatory_flags array<struct<regulation:string,description:string,type:string>>"
)
