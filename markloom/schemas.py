"""Schemas of the input tables and files."""

from __future__ import annotations

WARNING = "struct<level:string,text:string>"
CALL = (
    "struct<latencyMs:bigint,inputTokens:bigint,outputTokens:bigint,model:string,effort:string,cacheRead:bigint,cacheWrite:bigint>"
)
ITEM = (
    "struct<no:string,prompt:string,direction:string,prefix:string,written:string,blank:boolean,legible:boolean,"
    "erased:boolean,confidence:double>"
)

SHEETS = (
    "sheet_id STRING, class_name STRING, title STRING, student_name STRING, cut_line STRING, strict_spelling BOOLEAN, "
    "received_by STRING, status STRING, attempts INT, claimed_at TIMESTAMP, printed_total INT, missing INT, verdict STRING, "
    "near_boundary BOOLEAN, margin INT, cost_usd DECIMAL(10,4), graded_at TIMESTAMP, final_verdict STRING, "
    f"confirmed_at TIMESTAMP, created_at TIMESTAMP, warnings ARRAY<{WARNING}>, token_usage ARRAY<{CALL}>"
)
ITEMS = (
    "sheet_id STRING, seq INT, no STRING, prompt STRING, direction STRING, prefix STRING, written STRING, blank BOOLEAN, "
    "legible BOOLEAN, erased BOOLEAN, confidence DECIMAL(4,3), correct BOOLEAN, expected STRING, note STRING, "
    "teacher_correct BOOLEAN, reviewed_at TIMESTAMP"
)
TRANSCRIPTS = (
    "sheet_id STRING, page INT, title STRING, teacher STRING, student STRING, cut_line STRING, printed_total INT, "
    f"items ARRAY<{ITEM}>"
)
JUDGEMENTS = "sheet_id STRING, no STRING, pos INT, correct BOOLEAN, expected STRING, note STRING"
MARKS = "sheet_id STRING, mark_no STRING"
USAGE = (
    "id STRING, staff_id STRING, kind STRING, sheet_id STRING, pages INT, cost_usd DECIMAL(10,4), latency_ms INT, model STRING, "
    "effort STRING, ok BOOLEAN, created_at TIMESTAMP"
)
ANSWER_KEYS = (
    "slug STRING, title STRING, items ARRAY<STRUCT<no:STRING,expected:STRING,prompt:STRING>>, source_file_id STRING, "
    "source_modified TIMESTAMP, updated_at TIMESTAMP"
)
EXAM_REFS = "fingerprint STRING, title STRING, items ARRAY<STRUCT<no:STRING,prompt:STRING,direction:STRING,expected:STRING>>"

RUN = (
    "pair_no BIGINT, sheet STRUCT<title:STRING,teacher:STRING,cut_line:STRING>, n_items BIGINT, cost DOUBLE, error STRING, "
    "compare STRUCT<n:BIGINT,agree:BIGINT,verdict_match:BOOLEAN,near_boundary:BOOLEAN,ours_only:ARRAY<STRING>,theirs_only:ARRAY<STRING>>, "
    f"warn ARRAY<{WARNING}>"
)
SHORT_ITEMS = "array<struct<n:string,p:string,d:string,x:string,w:string,b:boolean,l:boolean,e:boolean>>"
