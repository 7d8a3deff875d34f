"""Schemas of the engine's relations."""

from __future__ import annotations




FILES = "project string, path string, parts array<string>, source string, lines int, sha256 string"
CHUNK = "chunk_id string, project string, path string, kind string, name string, start_line int, end_line int, text string"
MANIFEST_FILE = "struct<project:string,path:string,lines:int,sha256:string>"
MANIFEST_PROJECT = "struct<repository:string,commit:string,files:int,lines:int>"
MANIFEST = f"manifest_version int, generated string, projects map<string,{MANIFEST_PROJECT}>, totals struct<files:int,lines:int>, files array<{MANIFEST_FILE}>"
GOLDEN = "protocol map<string,string>, questions array<struct<id:string,q:string,relevant:array<string>,difficulty:string>>"
SPLIT = "method string, seed bigint, dev array<string>, test array<string>"
#: A ranked list: rank is data, from 1.
RANKED = "qid string, idx bigint, rank int"
METRICS = ("hit_rate@1", "hit_rate@3", "hit_rate@5", "hit_rate@10", "recall@1", "recall@3", "recall@5", "recall@10", "mrr", "ndcg@10")
