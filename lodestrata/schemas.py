"""Schemas and keys of the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = {
    "projects": "id string, mod_id string, name string, description string, author string, version string, build_target string, publish_status string, total_runs int, success_count int, created_at timestamp, updated_at timestamp, last_run_at timestamp, metadata string",
    "runs": "id string, project_id string, run_number int, run_label string, status string, governance_tier string, plan string, user_request string, context_chunks array<string>, retry_count int, max_retries int, started_at timestamp, ended_at timestamp, errors array<string>, error_summary string, artifact_id string, assigned_to string",
    "artifacts": "id string, run_id string, version string, checksum string, file_count int, total_size_bytes bigint, commit_sha string, git_branch string, validation_summary string, created_at timestamp",
    "files": "id string, artifact_id string, file_path string, file_type string, file_role string, content_hash string, size_bytes int, lint_score int, lint_warnings int, created_at timestamp",
    "dependencies": "id string, project_id string, dependent_id string, dependency_type string, version_min string, version_max string, external_id string, external_url string, created_at timestamp",
    "knowledge_chunks": "id string, project_id string, category string, subcategory string, content_text string, content_hash string, source_url string, source_type string, source_date date, source_title string, chunk_index int, token_count int, created_at timestamp, last_used_at timestamp, tags array<string>, metadata string",
    "api_reference": "id string, element_name string, element_type string, build_target string, deprecated_in string, removed_in string, description string, syntax string, parameters array<string>, return_value string, example_code string, source string, created_at timestamp, updated_at timestamp",
    "test_scenarios": "id string, project_id string, scenario_name string, description string, test_type string, validation_level string, test_script string, expected_outcome string, success_criteria string, last_run_at timestamp, last_result string, last_error string, created_at timestamp",
    "fix_attempts": "id string, run_id string, fix_number int, validation_level string, error_type string, error_message string, fix_description string, files_modified array<string>, resolved boolean, new_errors array<string>, created_at timestamp",
    "validation_results": "id string, run_id string, artifact_id string, validation_level string, result string, duration_ms int, files_checked int, errors_found int, warnings_found int, output_log string, error_details array<string>, started_at timestamp, ended_at timestamp",
    "publish_log": "id string, project_id string, artifact_id string, publish_type string, status string, error_message string, publish_url string, validation_passed boolean, human_approved boolean, approved_by string, requested_at timestamp, completed_at timestamp",
    "users": "id string, username string, email string, role string, can_publish boolean, can_merge boolean, can_escalate boolean, can_view_secrets boolean, created_at timestamp, last_login_at timestamp",
    "ingestion_runs": "id string, source_type string, source_url string, source_file string, status string, chunks_generated int, chunks_failed int, errors array<string>, duration_ms int, started_at timestamp, ended_at timestamp, metadata string",
    "data_coverage": "id string, category string, item_name string, is_documented boolean, data_completeness_score double, last_ingested_at timestamp, ingestion_run_id string, notes string, created_at timestamp, updated_at timestamp",
    "collection_health": "id string, collection_name string, chunk_count int, vector_dim int, last_ingested_at timestamp, is_healthy boolean, error_detail string, updated_at timestamp",
    "data_links": "id string, source_category string, source_name string, target_category string, target_name string, link_type string, confidence double, metadata string, created_at timestamp",
}
#: Keys by which rows are upserted (coverage and links have none of their own, so they get one here).
KEYS = {
    "chunks": ["collection", "chunk_id"], "collection_health": ["collection_name"], "data_coverage": ["category", "item_name", "ingestion_run_id"],
    "data_links": ["source_category", "source_name", "target_category", "target_name", "link_type"], "api_reference": ["element_name"],
    "projects": ["mod_id"], "runs": ["project_id", "run_number"], "artifacts": ["run_id", "version"], "files": ["artifact_id", "file_path"], "users": ["username"],
}


def typed(rows: DataFrame, table: str) -> DataFrame:
    """Rows with the columns and types of a relational table; columns they lack are null, others go."""
    fields = StructType.fromDDL(TABLES[table])
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
