"""Registered queries of this subpackage and the SQL that checks them where SQL can."""

from quellwerk.llm.encoding import p6_ids, p6_token_totals
from quellwerk.llm.neighbours import p3_found, p3_groups
from quellwerk.llm.packing import p7_fill, p7_found
from quellwerk.llm.pairs import p1_counts, p1_found
from quellwerk.llm.personal import p2_found, p2_redacted
from quellwerk.llm.pieces import p5_found, p5_pieces
from quellwerk.llm.sentences import p8_found, p8_lengths
from quellwerk.llm.splits import p4_assignment, p4_deviation, p4_found

QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_redacted, p3_found, p3_groups, p4_found, p4_assignment, p4_deviation, p5_found, p5_pieces, p6_ids, p6_token_totals, p7_found, p7_fill, p8_found, p8_lengths)}

_GAP = r"[\s\x0b\x85\p{Z}]+"

ORACLE_SQL = {
    "p3_found": rf"""
        WITH texts AS (SELECT DISTINCT report_id, lower(content) AS c FROM reports WHERE content IS NOT NULL AND report_id IS NOT NULL),
        words AS (SELECT report_id, list_filter(regexp_split_to_array(c, '{_GAP}'), lambda x: x <> '') AS w FROM texts),
        shingles AS (
            SELECT DISTINCT report_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
            FROM (SELECT report_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
        sizes AS (SELECT report_id, count(*) AS n FROM shingles GROUP BY report_id),
        common AS (
            SELECT a.report_id AS report_id_a, b.report_id AS report_id_b, count(*) AS k
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.report_id < b.report_id GROUP BY ALL)
        SELECT report_id_a, report_id_b FROM common JOIN sizes x ON x.report_id = report_id_a JOIN sizes y ON y.report_id = report_id_b
        WHERE k >= 0.7 * (x.n + y.n - k) - 1e-9""",
    "p4_found": """
        WITH RECURSIVE links AS (
            SELECT try_cast(regexp_replace(patient_id, '[^0-9]', '', 'g') AS BIGINT) AS a, try_cast(regexp_replace(other_patient_id, '[^0-9]', '', 'g') AS BIGINT) AS b
            FROM patient_links WHERE lower(trim(link_status)) = 'active'),
        both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(p, q) AS (SELECT a, a FROM both_ways UNION SELECT r.p, l.b FROM reach r JOIN both_ways l ON l.a = r.q),
        labels AS (SELECT p, min(q) AS label FROM reach GROUP BY p),
        reps AS (
            SELECT lower(trim(report_id)) AS k, min(try_cast(regexp_replace(patient_id, '[^0-9]', '', 'g') AS BIGINT)) AS p
            FROM reports WHERE report_id IS NOT NULL GROUP BY 1),
        records AS (
            SELECT 'report' AS kind, k, p FROM reps
            UNION ALL SELECT DISTINCT 'qa', CAST(q.qa_id AS VARCHAR), r.p FROM qa_items q JOIN reps r ON lower(trim(q.report_id)) = r.k),
        named AS (
            SELECT record_kind AS kind, CASE WHEN record_kind = 'report' THEN lower(trim(record_key)) ELSE trim(record_key) END AS k, split_name
            FROM split_draft WHERE split_name IS NOT NULL)
        SELECT 'P' || lpad(CAST(coalesce(label, records.p) AS VARCHAR), 7, '0') AS group_id
        FROM records JOIN named USING (kind, k) LEFT JOIN labels ON labels.p = records.p WHERE records.p IS NOT NULL
        GROUP BY 1 HAVING count(DISTINCT split_name) > 1""",
    "p5_found": rf"""
        SELECT DISTINCT * FROM (
            SELECT 'reports' AS source_table, report_id AS record_key, content AS t FROM reports
            UNION ALL SELECT 'report_sections', section_id, section_content FROM report_sections)
        WHERE len(list_filter(regexp_split_to_array(t, '{_GAP}'), lambda x: x <> '')) > 350""".replace("SELECT DISTINCT *", "SELECT DISTINCT source_table, record_key"),
}
