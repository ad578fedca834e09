"""Shapes of the library's tables, as DDL."""

FILE = "path string, content binary"
LINE = "file string, line_no int, line string"
FINDING = "type string, file string, line int, text string, detector string, severity string"
DICTIONARY = "token string, text string"
CHANGE = "id string, type string, file string, line int, original string, replacement string, token string, helper_id string, helper_ref string, helper_source string"
PLAN = f"meta struct<tool:string,version:string,generated_at:string,project_root:string,dictionary:string>, changes array<struct<{', '.join(c.replace(' ', ':', 1) for c in CHANGE.split(', '))}>>"
BLOCK = "type:string,start_line:int,end_line:int,before:array<string>,after:array<string>"
DIFF = f"path string, status string, kind string, metadata struct<size:bigint,sha256:string>, changes array<struct<{BLOCK}>>"
RECONCILED = "path string, n int, status string"
MANIFEST = "meta struct<format:string,version:int,created_at:string,created_by:string>, payload struct<type:string,hash:struct<algorithm:string,value:string>>, lineage struct<lineage_id:string,parent:string,type:string>, execution map<string,string>, signatures array<struct<key_id:string,signature:string>>"
REGION = "id string, file string, start_line int, start_column int, end_line int, end_column int, state int, original string, modified string, hash string"
REGION_ERROR = "file string, line int, column int, message string"
HISTORY = "scope string, sequence bigint, previous_hash string, state_hash string"
PROVENANCE = "provenance_version string, history array<struct<step:string,actor:string,action:string,generated_at:string>>, provenance_hash string"
FUNCTION = "name string, file string, start_line int, end_line int, line_count int, signature string, source_excerpt array<string>"
EVIDENCE = "normalized_hash string, count bigint, total_lines bigint"
INDEX = "classification string, confidence double, evidence_hash string"
GOAL = "goal string, source_type string, count bigint, confidence double"
SPEC = "intent string, requirements array<string>, source_type string, count bigint"
SIGNATURE = "artifact string, key_id string, valid boolean"
ARTIFACT = "hash string, parent string, type string, ts timestamp, size bigint"
SCHEMAS = {name: value for name, value in dict(globals()).items() if name.isupper()}
