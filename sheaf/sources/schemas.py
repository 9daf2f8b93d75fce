"""Schemas of the back office and of the document store."""

from __future__ import annotations

from pyspark.sql import types as T

_STAMPS = "is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
#: Names and types of columns, and tables in the order in which a snapshot is restored: parents before children.
TABLES = {
    "permission_groups": f"id long, name string, code string, description string, {_STAMPS}",
    "system_functions": f"id long, name string, code string, module string, description string, {_STAMPS}",
    "permission_group_functions": "id long, group_id long, function_id long, can_view boolean, can_create boolean, can_update boolean, can_delete boolean",
    "issuing_units": f"id long, code string, name string, short_name string, parent_id long, address string, {_STAMPS}",
    "departments": f"id long, code string, name string, issuing_unit_id long, parent_id long, description string, {_STAMPS}",
    "positions": f"id long, code string, name string, department_id long, description string, {_STAMPS}",
    "users": "id long, username string, email string, hashed_password string, role string, permission_group_id long, department_id long, position_id long, sso_subject string, auth_source string, is_active boolean, created_at timestamp_ntz, last_login timestamp_ntz",
    "login_history": "id long, user_id long, username_snapshot string, login_type string, session_id string, login_at timestamp_ntz, logout_at timestamp_ntz, status string, ip_address string, detail string",
    "system_configs": f"id long, config_key string, config_value string, category string, data_type string, description string, updated_by long, {_STAMPS}",
    "documents": "id long, filename string, original_filename string, file_path string, file_size_kb double, status string, owner_id long, created_at timestamp_ntz, processed_at timestamp_ntz",
    "chunk_metadata": "id long, document_id long, chunk_index int, page_number int, start_line int, faiss_index_id long, content_preview string",
    "summary_history": "id long, document_id long, user_id long, summary_text string, is_reviewed boolean, reviewed_by long, created_at timestamp_ntz, updated_at timestamp_ntz",
    "work_assignment_documents": "id long, document_code string, title string, content_summary string, issuing_unit_id long, department_id long, assigned_by_user_id long, assigned_department_id long, due_date date, status string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "work_items": "id long, work_document_id long, title string, description string, assignee_user_id long, department_id long, position_id long, priority string, status string, due_date date, created_at timestamp_ntz, updated_at timestamp_ntz",
    "notice_documents": "id long, notice_code string, title string, content string, issuing_unit_id long, department_id long, posted_by_user_id long, effective_date date, status string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "system_logs": "id long, user_id long, action string, detail string, ip_address string, status_code int, created_at timestamp_ntz",
    "api_keys": f"id long, name string, description string, key_hash string, created_by long, {_STAMPS}",
}
CHUNKS = "chunk_id long, content string, metadata map<string,string>"
VECTORS = "chunk_id long, vector array<float>"
HISTORY = "filename string, summary string, timestamp string"


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
