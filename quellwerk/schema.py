"""The schema of session log entries."""

SESSION_LOG = (
    "timestamp STRING, session_id STRING, query_type STRING, patient STRUCT<id: STRING, name: STRING, dob: STRING>, "
    "`group` STRUCT<id: STRING, name: STRING, patient_count: INT, patients: ARRAY<STRUCT<id: STRING, name: STRING, dob: STRING>>>, "
    "query STRUCT<question: STRING, settings: STRUCT<k: INT, searchLevel: STRING, docTypes: ARRAY<STRING>, sectionTypes: ARRAY<STRING>, dateRange: STRUCT<start: STRING, `end`: STRING>>>, "
    "results STRUCT<answer: STRUCT<status: STRING, text: STRING, warnings: ARRAY<STRING>>, sources: ARRAY<STRUCT<section_id: STRING, report_id: STRING, patient_id: STRING, score: DOUBLE>>, sourceCount: INT, patientDistribution: MAP<STRING, INT>>, "
    "metadata STRUCT<modelId: STRING, latency: STRUCT<retrieval: INT, generation: INT, total: INT>, indexVersion: STRING>"
)
