"""Queries whose SQL both engines read alike; {table} stands for an input table."""

from __future__ import annotations

import string

from talkweave.plans.registry import load, register


def shared(name: str, sql: str) -> None:
    tables = sorted({f for _, f, _, _ in string.Formatter().parse(sql) if f})

    def run(spark, sf_dir):
        return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in tables})

    run.__name__ = name
    register(name, sql.format(**{t: t for t in tables}))(run)


shared("F1_should_redact", """SELECT label, role, label NOT IN ('ORG', 'LOCATION') AND coalesce(role, '') <> 'ORGANISATION' AS redact
    FROM (VALUES ('PERSON', 'PRIVATE_INDIVIDUAL'), ('ORG', NULL), ('LOCATION', 'PUBLIC_PLACE'), ('PHONE', 'ORGANISATION'), ('PHONE', NULL)) AS t(label, role)""")
shared("F6_document_kind", """SELECT id, CASE WHEN id LIKE '%summary%' THEN 'summary' WHEN id LIKE '%_en' THEN 'clean_en' WHEN id LIKE '%_si' THEN 'clean_si' ELSE 'transcript' END AS kind
    FROM (VALUES ('R1_U001'), ('R1_U001_en'), ('R1_U001_si'), ('R1_summary_en')) AS t(id)""")
shared("F8_empty_values", """SELECT id, CASE WHEN lower(trim(v)) IN ('', 'n/a', 'none', 'null') THEN NULL ELSE trim(v) END AS value FROM (VALUES (1, ' N/A'), (2, 'none'), (3, ' Bob '), (4, ''), (5, NULL)) AS t(id, v)""")
shared("F10_valid_dates", """SELECT d, m, y, y BETWEEN 1900 AND 2100 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND CASE WHEN m IN (4, 6, 9, 11) THEN 30 WHEN m = 2 AND (y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0)) THEN 29 WHEN m = 2 THEN 28 ELSE 31 END AS ok
    FROM (VALUES (29, 2, 2000), (29, 2, 1900), (31, 4, 1999), (31, 12, 1999), (0, 1, 2000), (1, 13, 2000)) AS t(d, m, y)""")
shared("F12_review_flag", "SELECT event_id, event_type <> 'view' OR value < 10 AS review FROM {events}")
shared("S4_shape_drift", """SELECT id, coalesce(a, b, c) AS text FROM (VALUES (1, 'x', NULL, NULL), (2, NULL, 'y', NULL), (3, NULL, NULL, 'z'), (4, NULL, NULL, NULL)) AS t(id, a, b, c)""")
shared("S7_gold_rows", "SELECT doc_id, CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS label FROM {labels} WHERE doc_id IS NOT NULL AND quality IS NOT NULL")
shared("S13_export", """SELECT concat('SPEAKER c', CAST(user_id % 5 AS STRING), ' 1 ', CAST(event_id AS STRING), ' ', CAST(CAST(floor(value) AS BIGINT) AS STRING), ' <NA> <NA> ', event_type, ' <NA> <NA>') AS line FROM {events}""")
shared("S19_release", """SELECT count(*) AS n_turns, count(DISTINCT conv_id) AS n_convs, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(turn) AS first_turn, max(turn) AS last_turn FROM {conversations}""")
shared("E6_link_dates", """WITH d AS (SELECT * FROM (VALUES ('R', 1, '1990-08-22'), ('R', 2, '????-08-22'), ('R', 3, '????-01-01'), ('S', 4, '1990-08-22'), ('S', 5, '1991-08-22'), ('S', 6, '????-08-22')) AS t(rid, id, v)),
    f AS (SELECT rid, substring(v, 6, 5) AS md, min(v) AS full_v FROM d WHERE v NOT LIKE '?%' GROUP BY rid, substring(v, 6, 5) HAVING count(DISTINCT v) = 1)
    SELECT d.rid, d.id, CASE WHEN d.v LIKE '?%' THEN coalesce(f.full_v, d.v) ELSE d.v END AS value FROM d LEFT JOIN f ON d.rid = f.rid AND substring(d.v, 6, 5) = f.md""")
shared("R6_script_view", """SELECT user_id, bool_or(event_type = 'view') AS has_view, bool_or(event_type = 'error') AS has_error, bool_and(value > 1) AS all_large FROM {events} GROUP BY user_id""")
shared("L13_out_of_fold", """WITH f AS (SELECT user_id % 5 AS fold, event_type, sum(value) AS s, count(*) AS n FROM {events} GROUP BY user_id % 5, event_type), t AS (SELECT event_type, sum(s) AS s, sum(n) AS n FROM f GROUP BY event_type)
    SELECT f.fold, f.event_type, round((t.s - f.s) / (t.n - f.n), 4) AS predicted FROM f JOIN t ON f.event_type = t.event_type""")
shared("W11_by_script", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM {documents} GROUP BY GROUPING SETS ((lang), ())")
shared("W15_drift", """SELECT a.event_type, round(sum(abs(a.v - b.v)), 4) AS drift FROM (SELECT event_type, user_id, avg(value) AS v FROM {events} WHERE event_id % 2 = 0 GROUP BY event_type, user_id) a
    JOIN (SELECT event_type, user_id, avg(value) AS v FROM {events} WHERE event_id % 2 = 1 GROUP BY event_type, user_id) b ON a.event_type = b.event_type AND a.user_id = b.user_id GROUP BY a.event_type""")
shared("I14_per_speaker", """WITH s AS (SELECT event_type AS ref, concat('h', CAST(user_id % 3 AS STRING)) AS hyp, value AS d FROM {events}), k AS (SELECT ref, hyp, sum(d) AS t FROM s GROUP BY ref, hyp), r AS (SELECT ref, hyp, t, row_number() OVER (PARTITION BY ref ORDER BY t DESC, hyp) AS place, sum(t) OVER (PARTITION BY ref) AS total FROM k)
    SELECT ref, hyp AS mostly, round(t / total, 6) AS share FROM r WHERE place = 1""")
shared("V3_status_changes", "SELECT d.doc_id FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE (d.n_chars > 500) <> (l.quality = 1)")
shared("M4_insights", """WITH k AS (SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS e, count(*) AS n FROM {events} GROUP BY user_id) SELECT user_id, CASE WHEN e * 10 >= n * 3 THEN 'confusion' WHEN n < 5 THEN 'short' ELSE 'fine' END AS insight FROM k""")
shared("M8_rescored", "SELECT d.doc_id, coalesce(l.quality, -1) AS score FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
shared("M11_hypothesis_over_gold", "SELECT c.conv_id, c.turn, coalesce(h.text, c.text) AS text FROM {conversations} c LEFT JOIN (SELECT conv_id, turn, concat('h: ', text) AS text FROM {conversations} WHERE turn % 2 = 0) h ON c.conv_id = h.conv_id AND c.turn = h.turn")
shared("M12_lexicon", "SELECT lower(n_name) AS word FROM {nation} EXCEPT SELECT lower(r_name) FROM {region}")
shared("M15_reference_drift", """SELECT a.event_type, a.arm, round(a.v - b.v, 6) AS diff FROM (SELECT event_type, user_id % 3 AS arm, avg(value) AS v FROM {events} GROUP BY event_type, user_id % 3) a JOIN (SELECT event_type, avg(value) AS v FROM {events} WHERE user_id % 3 = 0 GROUP BY event_type) b ON a.event_type = b.event_type WHERE a.arm <> 0""")
shared("M16_pooled", "SELECT event_type, user_id % 3 AS seed, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END) / sum(value), 6) AS rate FROM {events} GROUP BY event_type, user_id % 3")
shared("M21_status_counts", "SELECT source, count(CASE WHEN n_chars < 300 THEN 1 END) AS fails, count(CASE WHEN n_chars BETWEEN 300 AND 600 THEN 1 END) AS warns, count(*) AS n FROM {documents} GROUP BY source")
shared("X9_latency", "SELECT user_id, round(max(value), 4) AS worst, round(avg(value), 4) AS mean, count(*) AS n FROM {events} GROUP BY user_id")
