"""Registration over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import people
from paperloom.workload.views import Tables, with_views

ADMIN = 7


def registration_state(spark, folder):
    table = people.student_table(Tables(spark, folder).requests)
    return table.select(
        "telegram_id", "telegram_name", "telegram_username", "full_name", "status", "handled_by",
        F.unix_micros("created_at").alias("created_us"), F.unix_micros("handled_at").alias("handled_us"),
    )


def refused_decisions(spark, folder):
    return people.refused_decisions(Tables(spark, folder).requests)


def registration_gate(spark, folder):
    t = Tables(spark, folder)
    gate = people.registration_gate(t.students.select("telegram_id"), people.student_table(t.requests))
    return gate.select("telegram_id", "gate", F.unix_micros("requested_at").alias("requested_us"))


def authorised_people(spark, folder):
    t = Tables(spark, folder)
    return people.authorised(t.students.select("telegram_id"), people.student_table(t.requests), ADMIN)


QUERIES = {f.__name__: f for f in (registration_state, refused_decisions, registration_gate, authorised_people)}

STATE_SQL = """known AS (SELECT telegram_id, min(ts) AS created, arg_max(name, (ts, seq)) AS telegram_name,
      max(struct_pack(ts := ts, seq := seq, username := username)).username AS telegram_username FROM requests
    WHERE kind IN ('contact', 'request') GROUP BY 1),
  asked AS (SELECT telegram_id, arg_max(name, (ts, seq)) AS full_name FROM requests WHERE kind = 'request' GROUP BY 1),
  last_word AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY telegram_id ORDER BY ts DESC, seq DESC) AS rn FROM requests
    WHERE kind <> 'contact') WHERE rn = 1),
  state AS (SELECT k.telegram_id, k.telegram_name, k.telegram_username, a.full_name,
    CASE WHEN decided AND l.kind = 'approve' THEN 'approved' WHEN decided THEN 'rejected' ELSE 'pending' END AS status,
    CASE WHEN decided THEN l.admin_id END AS handled_by, epoch_us(k.created) AS created_us, CASE WHEN decided THEN epoch_us(l.ts) END AS handled_us
    FROM known k LEFT JOIN asked a USING (telegram_id)
    LEFT JOIN (SELECT *, kind <> 'request' AND telegram_id IN (SELECT telegram_id FROM asked) AS decided FROM last_word) l USING (telegram_id))"""

SQL = {
    "registration_state": with_views("requests", f"{STATE_SQL} SELECT * FROM state"),
    "refused_decisions": with_views(
        "requests",
        """firsts AS (SELECT telegram_id, min((ts, seq)) FILTER (kind = 'request') AS r, min((ts, seq)) FILTER (kind IN ('contact', 'request')) AS c
             FROM requests GROUP BY 1)
           SELECT q.telegram_id, q.seq, q.kind, CASE WHEN c IS NULL OR c > (q.ts, q.seq) THEN 'unknown person' ELSE 'no application' END AS reason
           FROM requests q JOIN firsts USING (telegram_id) WHERE kind IN ('approve', 'reject') AND (r IS NULL OR r > (q.ts, q.seq))""",
    ),
    "registration_gate": with_views(
        "requests students",
        f"""{STATE_SQL} SELECT p.telegram_id, CASE WHEN s.status IS NULL OR s.status = 'rejected' THEN 'new' ELSE s.status END AS gate,
            CASE WHEN s.status = 'pending' THEN s.created_us END AS requested_us FROM students p LEFT JOIN state s USING (telegram_id)""",
    ),
    "authorised_people": with_views(
        "requests students",
        f"""{STATE_SQL} SELECT telegram_id FROM students WHERE telegram_id = 7
            OR telegram_id IN (SELECT telegram_id FROM state WHERE status = 'approved')""",
    ),
}
