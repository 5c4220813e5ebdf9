"""Schemas of the tables and records, as DDL."""

PAGE = "page int, text string, chapter string, ministry string, title string, effective string, tags array<string>, printed_page int"
DOCUMENTS = "id string, title string, source string, mime_type string, content_hash string, page_count int, created_at timestamp"
CHUNK_META = "struct<heading:string,chapter:string,ministry:string,title:string,effective:string,tags:array<string>,printed_page:int,token_count:int>"
CHUNKS = f"document_id string, index_version string, ord int, content string, embed_text string, page_start int, page_end int, meta {CHUNK_META}, embedding array<float>"
EVIDENCE = "struct<document_id:string,page:int,quote:string>"
POINT = f"struct<point:string,facts:array<string>,evidence:array<{EVIDENCE}>>"
ITEMS = f"id string, type string, question string, status string, provenance string, variant string, subtype string, answer string, answer_kind string, evidence array<{EVIDENCE}>, must_include array<{POINT}>, must_not array<string>, expected_status string, scoring map<string,string>, keywords array<string>, premise string"
HIT = "struct<ref:int,chunk_id:bigint,document_id:string,title:string,content:string,page_start:int,page_end:int,score:double,printed_page:int,heading:string>"
CITATION = "struct<ref:int,document_id:string,title:string,page_start:int,page_end:int,printed_page:int,heading:string,snippet:string,score:double>"
USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint>"
RECORDS = f"id string, `group` string, type string, repeat int, question string, status string, answer string, retrieved array<{HIT}>, citations array<{CITATION}>, warnings array<string>, usage {USAGE}, latency_ms bigint, error string, judge_tokens bigint"
CHECKS = "id string, repeat int, check_id string, kind string, target string, p double, ps array<double>, choice string, probabilities map<string,double>, choices array<string>"
DELTAS = "request_id string, seq bigint, text string, prompt_tokens bigint, completion_tokens bigint, ended boolean"
EVENTS = "request_id string, seq bigint, event string, payload string"
