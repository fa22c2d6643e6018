"""Explicit schemas of the stored tables; nothing is inferred at read time."""

CHUNKS = """
chunk_id string, document_id string, document_version string, chunk_index int, chunk_text string,
chunk_text_safe string, embedding array<float>, terms array<string>, domain string,
data_class string, pii_classification array<string>, metadata string, source_uri string,
created_at timestamp, updated_at timestamp, embedding_model_id string, is_active boolean
"""

DOCUMENTS = """
document_id string, title string, domain string, data_class string, source_uri string,
version string, total_chunks int, metadata string, created_at timestamp, updated_at timestamp,
created_by string, is_active boolean
"""

ONLINE_FEATURES = """
entity_token string, feature_set string, features map<string,double>, as_of timestamp,
expires_at timestamp, source string
"""

AUDIT = """
event_id string, event_type string, tool_name string, agent_id string, agent_role string,
session_id string, query_hash string, chunk_ids array<string>, pii_detected boolean,
pii_entity_types array<string>, pii_modes_applied array<string>, latency_ms int,
severity string, timestamp timestamp, event_date date
"""
