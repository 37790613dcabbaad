"""Schemas of the tables that operators take and give."""

from __future__ import annotations

DOCUMENT = "doc_id string, path string, title string, text string, metadata map<string,string>, doc_ord bigint"
CHUNK = "doc_ord bigint, doc_id string, pos int, text string, token_count int, heading_path array<string>"
QUERY = "query_id string, query string, expect_docs array<string>, query_ord bigint"
RANKED = "query_id string, query_ord bigint, doc_id string, chunk_id string, rank int, score float"
FINDING = "severity string, code string, message string, data string"

RETRIEVED_DOC = "struct<id:string,text:string,score:double,source:string,metadata:map<string,string>>"
CLAIM = "struct<text:string,supported:boolean,evidence_doc_ids:array<string>>"
ARTIFACT = f"question string, answer string, retrieved_docs array<{RETRIEVED_DOC}>, claims array<{CLAIM}>, metrics struct<total_delta:double>, context struct<model:string,top_k:int>"
RULE = "rule_ord int, id string, question string, grounded boolean, must_include array<string>, must_not_include array<string>, min_chars int, max_chars int, require_json boolean, json_required_keys array<string>"
