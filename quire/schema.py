"""Schemas of the tables of a document corpus, as Spark DDL."""

from __future__ import annotations

DOCS = "doc STRING, languages ARRAY<STRING>, title STRING, publication_time TIMESTAMP, modified_time TIMESTAMP, compiled_time TIMESTAMP, return_codes MAP<STRING,BOOLEAN>, anonymous_can_view BOOLEAN, author_can_add BOOLEAN, engine STRING, root BIGINT"
NODES = "doc STRING, node BIGINT, environ STRING, optarg ARRAY<STRING>, extensions ARRAY<STRING>, langs ARRAY<STRING>, original_filename STRING, access STRING, documentclass_choice STRING, created TIMESTAMP, modified TIMESTAMP, compiled TIMESTAMP, return_codes MAP<STRING,BOOLEAN>, order_in_document INT"
EDGES = "doc STRING, parent BIGINT, child BIGINT, ordinal INT"
ATTRS = "doc STRING, node BIGINT, key STRING, value STRING, value2 STRING"
SEGMENTS = "doc STRING, node BIGINT, lang STRING, ext STRING, text STRING"
INPUTS = "doc STRING, node BIGINT, lang STRING, pos INT, macro STRING, args STRING, path STRING, target BIGINT, target_file STRING, context STRING"
CATALOG = "doc STRING, node BIGINT, lang STRING, line INT, text STRING"
EDITS = "doc STRING, node BIGINT, lang STRING, ext STRING, user_id BIGINT, base_md5 STRING, content STRING, ts TIMESTAMP"
PROBLEMS = "doc STRING, code STRING, node BIGINT, message STRING, args ARRAY<STRING>"

#: Order number of a node that no walk from the root reaches.
NOT_IN_DOCUMENT = 2147483647
