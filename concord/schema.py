"""Schemas of the tables as DDL; stated, never inferred."""


SCHEMA_VERSION = 6


RECORDS = ("ord BIGINT, id STRING, title STRING, artist STRING, album STRING, code STRING, seconds BIGINT, explicit BOOLEAN, a_id STRING, b_id STRING, availability INT, created_at TIMESTAMP, updated_at TIMESTAMP")
LISTS = ("id STRING, name STRING, owner STRING, description STRING, a_id STRING, b_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP")
MEMBERS = ("list_id STRING, track_id STRING, position BIGINT")
MAPPINGS = ("source_service STRING, source_track_id STRING, target_service STRING, target_track_id STRING, confidence DOUBLE")
EXCLUSIONS = ("track_id STRING, target_service STRING, kind STRING, candidate_id STRING")
OUTCOMES = ("run_id STRING, recorded_at TIMESTAMP, source_service STRING, target_service STRING, source_track_id STRING, decision STRING, method STRING, top_score DOUBLE, candidate_count BIGINT")
RUNS = ("id STRING, started_at TIMESTAMP, completed_at TIMESTAMP, direction STRING, operations_count BIGINT, success_count BIGINT, failure_count BIGINT, status STRING, duration_seconds DOUBLE")
CHECKPOINTS = ("run_id STRING, op_key STRING, status STRING, previous_track_ids STRING, error STRING, updated_at TIMESTAMP")
LIST_STATE = ("service STRING, list_id STRING, digest STRING, synced_at TIMESTAMP")

# The shapes of the two services' JSON pages.
TRACK_A = "struct<id:string,name:string,artists:array<struct<name:string>>,album:struct<name:string>,duration_ms:bigint,explicit:boolean,external_ids:map<string,string>,is_local:boolean>"
PAGE_A = (f"items array<struct<track:{TRACK_A}>>, next string")
LIST_PAGE_A = ("items array<struct<id:string,name:string,description:string,owner:struct<display_name:string,id:string>>>, next string")
SEARCH_A = (f"tracks struct<items:array<{TRACK_A}>>")
SONG_B = "struct<id:string,attributes:struct<name:string,artistName:string,albumName:string,durationInMillis:bigint,contentRating:string,isrc:string,playParams:struct<catalogId:string>>>"
PAGE_B = (f"data array<{SONG_B}>, next string")
LIST_PAGE_B = ("data array<struct<id:string,attributes:struct<name:string,description:struct<standard:string>>>>, next string")
SEARCH_B = (f"results struct<songs:struct<data:array<{SONG_B}>>>")
