"""Schemas at the borders between stages."""

from __future__ import annotations

PARAGRAPH = "doc STRING, index INT, text STRING, word_style STRING, num_id INT, ilvl INT, num_fmt STRING, number STRING, marker STRING, is_empty BOOLEAN"

NODE = (
    "id STRING, type STRING, depth INT, title STRING, text STRING, parent_id STRING, children_count INT, position INT, number STRING, "
    "marker STRING, law_prefix STRING, law_code STRING, source_doc STRING, word_style STRING, start_idx INT, end_idx INT, implicit_parent BOOLEAN"
)

ISSUE = "rule_id STRING, node_id STRING, severity STRING, issue_type STRING, message STRING"

GRAPH_NODE = "id STRING, node_kind STRING, labels ARRAY<STRING>, properties MAP<STRING, STRING>, provenance ARRAY<STRING>"
GRAPH_EDGE = "source STRING, target STRING, type STRING, properties MAP<STRING, STRING>, provenance ARRAY<STRING>"

ROUTE = "node_id STRING, route STRING, routing_score DOUBLE, reason STRING"

EXTRACTION = (
    "node_id STRING, entities ARRAY<STRUCT<id: STRING, text: STRING, entity_type: STRING, evidence: STRING>>, "
    "relations ARRAY<STRUCT<source: STRING, relation_type: STRING, target: STRING, source_status: STRING, evidence: STRING>>"
)

NORM = (
    "id STRING, modality STRING, subject_ids ARRAY<STRING>, action_ids ARRAY<STRING>, object_ids ARRAY<STRING>, condition_ids ARRAY<STRING>, "
    "exception_ids ARRAY<STRING>, consequence_ids ARRAY<STRING>, condition_groups ARRAY<STRUCT<group_id: STRING, operator: STRING, condition_ids: ARRAY<STRING>, is_complex: BOOLEAN>>, "
    "subject_status STRING, norm_completeness STRING, provenance_node_id STRING, evidence STRING, rule_id STRING, status STRING"
)

# Node types by depth.
DEPTHS = {"CHAPTER": 0, "SECTION": 1, "ARTICLE": 2, "CLAUSE": 3, "POINT": 4}
