"""Fixed schemas of the stored tables, as DDL strings that every reader accepts. Nothing is inferred at read time.

``seq`` is the arrival order of a raw row; every "first wins" or "last wins" rule is defined on it.
"""

from __future__ import annotations

SECTIONS = (
    "section_id STRING, topic STRING, chapter STRING, subchapter STRING, outline STRING, content STRING, "
    "keywords ARRAY<STRING>, language STRING, chapter_pos INT, subchapter_pos INT, content_hash STRING"
)
KG_NODES = (
    "scope STRING, id STRING, name STRING, type STRING, description STRING, aliases ARRAY<STRING>, "
    "canonical_key STRING, chapter STRING, subchapter STRING, score DOUBLE, source STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP, seq BIGINT"
)
KG_EDGES = (
    "scope STRING, rid STRING, type STRING, source_id STRING, target_id STRING, source_name STRING, "
    "target_name STRING, description STRING, evidence STRING, confidence DOUBLE, weight DOUBLE, chapter STRING, "
    "src_section STRING, created_at TIMESTAMP, updated_at TIMESTAMP, seq BIGINT"
)
KG_SECTIONS = "section_id STRING, scope STRING, hierarchy STRING, chapter STRING"
MENTIONS = "chunk_id STRING, node_id STRING, scope STRING"
ATTEMPTS = "section_id STRING, attempt INT, content STRING, report STRING"
RUN_LOG = "timestamp BIGINT, message STRING, level STRING, run_id STRING"
RUN_EVENTS = "run_id STRING, ts TIMESTAMP, message STRING, level STRING"
CALL_EVENTS = (
    "ts TIMESTAMP, provider STRING, key_id STRING, agent STRING, model STRING, status_code INT, latency_ms BIGINT, "
    "prompt_tokens BIGINT, completion_tokens BIGINT, total_tokens BIGINT, seq BIGINT"
)
RUN_REQUESTS = "topic STRING, language STRING, chapter_count INT, workflow_id STRING, workflow_params MAP<STRING,STRING>"

DEFAULT_CONTENT_LANGUAGE = "中文"
