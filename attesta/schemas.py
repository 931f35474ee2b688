"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

# A registry record, as far as it is read. A version-0 file wraps it in ``study``.
_OUTCOME = "array<struct<measure:string,timeFrame:string,description:string>>"
PROTOCOL = (
    "struct<identificationModule:struct<nctId:string,briefTitle:string>,"
    "statusModule:struct<overallStatus:string,startDateStruct:struct<date:string>,primaryCompletionDateStruct:struct<date:string>,studyFirstPostDateStruct:struct<date:string>>,"
    "sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string,class:string>>,conditionsModule:struct<conditions:array<string>>,"
    "designModule:struct<phases:array<string>,enrollmentInfo:struct<count:int>>,"
    f"outcomesModule:struct<primaryOutcomes:{_OUTCOME},secondaryOutcomes:{_OUTCOME}>,"
    "armsInterventionsModule:struct<armGroups:array<struct<label:string,type:string,description:string>>>,"
    "eligibilityModule:struct<minimumAge:string,maximumAge:string,sex:string,eligibilityCriteria:string>>"
)
RECORD = (
    f"protocolSection {PROTOCOL}, hasResults boolean, "
    "resultsSection struct<outcomeMeasuresModule:struct<outcomeMeasures:array<struct<type:string,title:string,timeFrame:string,description:string>>>>, "
    "documentSection struct<largeDocumentModule:struct<largeDocs:array<struct<filename:string,hasProtocol:boolean,hasSap:boolean,hasIcf:boolean>>>>"
)
VERSION0 = f"studyVersion int, study struct<protocolSection:{PROTOCOL}>"
HISTORY = "changes array<struct<version:int,date:string,status:string,studyType:string,moduleLabels:array<string>,lastUpdateSubmitQcDate:string>>"

TRIALS = (
    "nct_id string, brief_title string, sponsor_name string, sponsor_class string, phase string, conditions string, enrollment_count int, overall_status string, "
    "start_date string, primary_completion_date string, first_post_date string, has_results boolean, has_protocol boolean, has_sap boolean"
)
OUTCOMES = "nct_id string, source string, type string, measure string, time_frame string, description string, outcome_id long"
ARMS = "nct_id string, label string, type string, description string, arm_id long"
ELIGIBILITY = "nct_id string, minimum_age string, maximum_age string, sex string, criteria string"
AMENDMENTS = "nct_id string, version int, date string, status string, modules_changed array<string>"

CHUNKS = (
    "chunk_id string, nct_id string, doc_type string, doc_version double, section string, page_range string, chunk_type string, is_ocr boolean, chunk_index int, text string, "
    "embedding array<float>"
)
CHUNK_TYPES = ("text", "table", "assessment_schedule")

# The append-only trace: five linked tables.
TRACE = {
    "query": "query_id long, text string, tier string, created_at timestamp",
    "retrieval_step": "step_id long, query_id long, stage string, latency_ms double, filters_applied string, created_at timestamp",
    "chunk_hit": "step_id long, chunk_id string, rank int, score double, nct_id string, doc_type string, section string, page_range string",
    "generation": "generation_id long, query_id long, model_digest string, prompt_hash string, response_text string, latency_ms double, token_count long, created_at timestamp",
    "cost_record": "generation_id long, tokens_in long, tokens_out long, wall_clock_ms double, from_cache boolean",
}
EMBEDDING_CACHE = "chunk_id string, cache_key string, embedding array<float>"
QUESTIONS = "question_id string, tier string, nct_id string, template string, question_text string, gold_answer string, gold_chunk_ids array<string>"
