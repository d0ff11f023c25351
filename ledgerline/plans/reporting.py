"""Queries of reports and of the batch classifier with their oracle SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import classify as cl
from ledgerline.operators import reports as rp

from .adapters import record
from .process import ONBOARDING
from .sql import over_record

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, build, sql: str, by_application: tuple[str, ...] = ()) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(record(spark, sf_dir, by_application))
    ORACLES[name] = over_record(sql)


SINCE = datetime(2001, 6, 1)
add("render_chain", lambda r: rp.render_chain(r.subject), "SELECT application_id, string_agg(concat(idx, '. [', direction, '] ', substr(subject, 1, 160)), chr(10) ORDER BY idx) AS chain FROM subject GROUP BY 1")
add(
    "company_timelines", rp.company_timelines,
    """SELECT c.id AS company_id, coalesce(m.n, 0) AS messages, coalesce(m.u, 0) AS unlinked, m.first_at, m.last_at, coalesce(a.n, 0) AS applications, coalesce(k.n, 0) AS claims, CAST(year(m.last_at) - year(m.first_at) + 1 AS INTEGER) AS years FROM company c
LEFT JOIN (SELECT company_id, count(*) AS n, count(*) FILTER (application_id IS NULL) AS u, min(sent_at) AS first_at, max(sent_at) AS last_at FROM message GROUP BY 1) m ON m.company_id = c.id
LEFT JOIN (SELECT company_id, count(*) AS n FROM application GROUP BY 1) a ON a.company_id = c.id LEFT JOIN (SELECT company_id, count(*) AS n FROM cur GROUP BY 1) k ON k.company_id = c.id""",
)
add(
    "summary_fingerprints", rp.fingerprints,
    """SELECT m.company_id, sha256(concat_ws(':', m.company_id, m.n, strftime(m.sent, '%Y-%m-%d %H:%M:%S'), coalesce(strftime(k.moved, '%Y-%m-%d %H:%M:%S'), '-'))) AS fingerprint
FROM (SELECT company_id, count(*) AS n, max(sent_at) AS sent FROM message GROUP BY 1) m LEFT JOIN (SELECT company_id, max(occurred_at) AS moved FROM cur GROUP BY 1) k USING (company_id)""",
)
add("stage_movement", lambda r: rp.stage_movement(r, SINCE), "SELECT stage, company_id, count(*) AS n FROM cur WHERE occurred_at >= TIMESTAMP '2001-06-01' GROUP BY ALL")
add("new_companies", lambda r: rp.new_companies(r, datetime(1995, 6, 1)), "SELECT company_id, min(sent_at) AS first_at FROM message GROUP BY 1 HAVING min(sent_at) >= TIMESTAMP '1995-06-01'")
add("mailbox_facts", rp.mailbox_facts, "SELECT (SELECT count(*) FROM message) AS messages, (SELECT count(*) FILTER (classified_by IS NOT NULL AND classified_by NOT LIKE 'model%') / count(classified_by) FROM message) AS free_share, (SELECT count(*) FROM company WHERE kind = 'employer') AS employers, (SELECT count(*) FROM company WHERE kind = 'agency') AS agencies, (SELECT count(*) FROM application) AS applications")
add(
    "company_dossiers", rp.company_dossiers,
    """SELECT m.company_id, m.messages, array_to_string(m.s[1:4], ',') AS senders, array_to_string(m.i[1:5], ',') AS newest, a.applications FROM (
  SELECT company_id, count(*) AS messages, list_sort(list(DISTINCT sender_domain)) AS s, list(id ORDER BY sent_at DESC, id) AS i FROM message GROUP BY 1) m LEFT JOIN (SELECT company_id, count(*) AS applications FROM application GROUP BY 1) a USING (company_id)""",
)
add("application_dossiers", rp.application_dossiers, "SELECT application_id, string_agg(stage, ' > ' ORDER BY occurred_at, id) AS stages FROM cur GROUP BY 1")
add("company_tally", lambda r: rp.tally(r.message.filter("classified_by = 'rule-carry'").select("id"), r), "SELECT company_id, canonical_name, count(*) AS n FROM message m JOIN company c ON c.id = m.company_id WHERE classified_by = 'rule-carry' GROUP BY 1, 2")


def _runs(r):
    return r.application.select("id", "started_at", F.when(F.col("id") % 3 > 0, F.col("started_at") + F.expr("INTERVAL 2 HOURS")).alias("finished_at"), (F.col("started_at") + F.expr("INTERVAL 1 HOUR")).alias("last_beat"), (F.col("id") % 50).alias("done"), F.lit(50).alias("total"))


add(
    "run_report", lambda r: rp.run_report(_runs(r), datetime(2002, 1, 1)).select("id", "active", "elapsed", "per_minute", "to_go", "stalled"),
    """SELECT id, active, elapsed, per_minute, CASE WHEN active AND per_minute > 0 THEN (50 - done) * 60 / per_minute END AS to_go, active AND epoch(TIMESTAMP '2002-01-01' - beat) > 20 AS stalled
FROM (SELECT *, CASE WHEN elapsed > 0 THEN done * 60 / elapsed END AS per_minute FROM (SELECT id, id % 3 = 0 AS active, id % 50 AS done, started_at + INTERVAL 1 HOUR AS beat, epoch(CASE WHEN id % 3 = 0 THEN TIMESTAMP '2002-01-01' ELSE started_at + INTERVAL 2 HOUR END - started_at) AS elapsed FROM application))""",
)
add(
    "thread_inputs", rp.thread_inputs,
    "SELECT thread_id, count(*) AS members, min(sent_at) AS began, (list(id ORDER BY sent_at DESC, id DESC))[1] AS id, array_to_string(list_sort(list(DISTINCT sender_domain))[1:6], ',') AS senders FROM message GROUP BY 1",
)
add(
    "fresh_readings", lambda r: rp.fresh_readings(r.message.filter("classified_by = 'model-x'").groupBy("thread_id").agg(F.max("sent_at").alias("covers_sent_at")), r),
    "SELECT thread_id, c AS covers_sent_at FROM (SELECT thread_id, max(sent_at) FILTER (classified_by = 'model-x') AS c, max(sent_at) AS m FROM message GROUP BY 1) WHERE c >= m",
)
add(
    "message_details", rp.message_details,
    """SELECT m.id, c.canonical_name, a.role_title, coalesce(e.evidence, '') AS evidence FROM message m LEFT JOIN company c ON c.id = m.company_id LEFT JOIN application a ON a.id = m.application_id
LEFT JOIN (SELECT evidence_message_id, string_agg(x, ',' ORDER BY x) AS evidence FROM (SELECT evidence_message_id, concat_ws('/', stage, coalesce(role_title, '-')) AS x FROM cur JOIN application a ON a.id = cur.application_id) GROUP BY 1) e ON e.evidence_message_id = m.id""",
)
add(
    "enrichment_backlog", lambda r: rp.enrichment_backlog(r, r.company.filter("id % 2 = 0").select(F.col("id").alias("company_id"), F.when(F.col("id") % 4 == 0, F.col("domain")).otherwise(F.lit("old.example")).alias("domain"))),
    "SELECT c.id AS company_id, c.domain, coalesce(n, 0) AS messages FROM company c LEFT JOIN (SELECT company_id, count(*) AS n FROM message GROUP BY 1) m ON m.company_id = c.id WHERE domain IS NOT NULL AND c.id % 4 <> 0",
)
add("find_company", lambda r: rp.find_company(r, "www.CO15.example"), "SELECT id, canonical_name, domain FROM company WHERE domain = 'co15.example'")
add("verification_inputs", lambda r: rp.verification_inputs(r, r.company.filter("kind = 'agency'").select(F.col("id").alias("company_id"))), "SELECT company_id, id, CAST(least(n, 60) - b + 1 AS INTEGER) AS n FROM (SELECT m.company_id, m.id, row_number() OVER (PARTITION BY m.company_id ORDER BY sent_at DESC, m.id DESC) AS b, count(*) OVER (PARTITION BY m.company_id) AS n FROM message m JOIN company c ON c.id = m.company_id AND kind <> 'agency') WHERE b <= 60")
# classifier
_RAW = """CASE WHEN length(sender_domain) % 2 = 0 THEN '[' ELSE '' END || '{"label": "' || CASE WHEN direction = 'inbound' THEN 'positive' WHEN classified_by IS NULL THEN 'negative' ELSE 'odd' END || '", "company_name": "' || CASE WHEN application_id % 3 = 0 THEN ' N/A ' WHEN application_id % 3 = 1 THEN 'stealth startup' ELSE 'Acme' END
 || '", "stage": " Offer", "company_kind": "x", "company_domain": null, "occurred_at": "2024-01-02"}' || CASE WHEN length(sender_domain) % 2 = 0 THEN ', {}]' ELSE '' END"""


def _readings(r):
    return cl.coerce(r.message.select("id", F.expr(_RAW).alias("raw")))


_OK = "length(sender_domain) % 2 = 1"
_LABEL = f"CASE WHEN {_OK} THEN CASE WHEN direction = 'inbound' THEN 'positive' WHEN classified_by IS NULL THEN 'negative' ELSE 'unclassified' END END"
add("coerce_readings", lambda r: _readings(r).select("id", "ok", "label", "company_name", "stage", "company_kind"), f"SELECT id, {_OK} AS ok, {_LABEL} AS label, CASE WHEN {_OK} THEN CASE application_id % 3 WHEN 1 THEN 'stealth startup' WHEN 2 THEN 'Acme' END END AS company_name, CASE WHEN {_OK} THEN 'offer' END AS stage, CAST(NULL AS VARCHAR) AS company_kind FROM message")
add(
    "route_readings", lambda r: cl.route(_readings(r).filter("ok")).groupBy("branch", "reason").agg(F.count(F.lit(1)).alias("n")),
    f"""SELECT branch, CASE WHEN branch = 'queue' THEN CASE WHEN label = 'positive' THEN 'job-related but no company identified' ELSE 'unclassified' END END AS reason, count(*) AS n FROM (
  SELECT label, CASE WHEN label = 'negative' THEN 'negative' WHEN label = 'positive' AND application_id % 3 = 2 THEN 'record' ELSE 'queue' END AS branch FROM (SELECT *, {_LABEL} AS label FROM message WHERE {_OK})) GROUP BY ALL""",
)
add(
    "plan_calls",
    lambda r: cl.plan_calls(r.message.filter("classified_by IS NULL").join(r.subject.select("id", "subject"), "id").withColumn("text", F.lit("")), r.correspondence.select("id", F.when(F.col("bulk"), "negative").otherwise("undecided").alias("status"), F.col("known_contact").alias("explored")), r.message.filter("classified_by = 'rule-carry'").select("thread_id").distinct(), r.message.filter("sender_domain LIKE 's1%'").select("thread_id").distinct()),
    """SELECT (list(m.id ORDER BY m.sent_at DESC, m.id DESC))[1] AS id, m.thread_id, CASE WHEN bool_or(regexp_matches(lower(s.subject), 'offer letter|welcome to |background check|h-1b')) THEN 'strong' ELSE 'cheap' END AS tier FROM message m JOIN subject s ON s.id = m.id JOIN correspondence c ON c.id = m.id
WHERE classified_by IS NULL AND NOT (c.bulk AND NOT c.known_contact) AND thread_id NOT IN (SELECT thread_id FROM message WHERE classified_by = 'rule-carry') AND thread_id NOT IN (SELECT thread_id FROM message WHERE sender_domain LIKE 's1%') GROUP BY 2""",
)
add(
    "review_sweep",
    lambda r: cl.sweep(r.review_queue.filter("status = 'pending'").select("id", "message_id"), [("thread", r.message.filter("sender_domain LIKE 's1%'").select(F.col("id").alias("message_id"), "company_id")), ("prefilter", r.correspondence.filter("bulk").select(F.col("id").alias("message_id"), F.lit(None).cast("long").alias("company_id"))), ("domain", r.message.filter("direction = 'outbound'").select(F.col("id").alias("message_id"), "company_id"))]).select("id", "outcome", "company_id"),
    """SELECT q.id, CASE WHEN m.sender_domain LIKE 's1%' THEN 'thread' WHEN c.bulk THEN 'prefilter' WHEN m.direction = 'outbound' THEN 'domain' ELSE 'stays' END AS outcome, CASE WHEN m.sender_domain LIKE 's1%' THEN m.company_id WHEN c.bulk THEN NULL WHEN m.direction = 'outbound' THEN m.company_id END AS company_id
FROM review_queue q JOIN message m ON m.id = q.message_id JOIN correspondence c ON c.id = q.message_id WHERE q.status = 'pending'""",
)
_TRIAGE = lambda r: r.correspondence.filter("label IS NULL").select("id", (~F.col("bulk")).alias("job_related"))
add("triage", lambda r: cl.triage(r.message.select("id"), _TRIAGE(r)), "SELECT id FROM correspondence WHERE label IS NOT NULL OR NOT bulk")
add("triage_savings", lambda r: cl.triage_savings(r.message.select("id"), _TRIAGE(r), r.message.select("id", (F.col("direction") == "inbound").alias("job_related"))), "SELECT count(*) FILTER (NOT k) AS avoided, count(*) FILTER (NOT k AND direction <> 'inbound') / count(*) FILTER (direction <> 'inbound') AS noise_recall, count(*) FILTER (NOT k AND direction = 'inbound') AS missed FROM (SELECT m.direction, label IS NOT NULL OR NOT bulk AS k FROM message m JOIN correspondence USING (id))")
_CHAIN = lambda r: r.subject.join(r.stage_event.select("application_id", "id", "stage", "occurred_at"), ["application_id", "id"])
add(
    "derivation_gates",
    lambda r: cl.derivation_gates(_CHAIN(r).select("application_id", "idx", "stage"), _CHAIN(r).drop("stage"), "Acme Robotics").select("id", "application_id", "stage"),
    """, g0 AS (SELECT s.*, e.stage, e.occurred_at FROM subject s JOIN stage_event e USING (id)),
g1 AS (SELECT *, count(*) FILTER (stage NOT IN ('accepted', 'declined', 'rejected', 'withdrawn')) OVER (PARTITION BY application_id) AS funnel FROM g0 WHERE CASE
    WHEN stage = 'offer' THEN subject IN ('Welcome to Acme Robotics', 'Your offer letter', 'Welcome to our newsletter') AND (direction <> 'outbound' OR subject = 'Your offer letter')
    WHEN stage IN ('accepted', 'declined') THEN subject <> 'Accepted: Interview with Acme' AND (sender <> 'sign@docusign.example' OR subject IN ('Welcome to Acme Robotics', 'Your offer letter', 'Welcome to our newsletter')) ELSE true END
  AND (stage <> 'accepted' OR subject <> 'Welcome to our newsletter')),
g2 AS (SELECT *, stage IN ('accepted', 'declined', 'rejected', 'withdrawn') AS t, CASE stage WHEN 'applied' THEN 0 WHEN 'recruiter_screen' THEN 1 WHEN 'phone_screen' THEN 2 WHEN 'technical' THEN 3 WHEN 'onsite' THEN 4 WHEN 'offer' THEN 5 END AS p FROM g1 WHERE stage <> 'accepted' OR funnel > 0),
g3 AS (SELECT *, coalesce(bool_or(t) OVER b, false) AS ended, coalesce(max(p) OVER b, -1) AS high FROM g2 WINDOW b AS (PARTITION BY application_id ORDER BY occurred_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, application_id, stage FROM g3 WHERE t OR (NOT ended AND p > high)""",
    ("subject", "stage_event"),
)
_CLAIMS = lambda r: r.stage_event.filter("stage <> 'accepted' OR application_id % 2 = 0").select("id", "application_id", "stage", "occurred_at")
add(
    "onboarding_claims", lambda r: cl.onboarding_claims(_CLAIMS(r), _CHAIN(r).drop("stage"), "Acme Robotics").select("id", "application_id", "stage"),
    f""", oa AS ({ONBOARDING}), c0 AS (SELECT id, application_id, stage, occurred_at FROM stage_event WHERE stage <> 'accepted' OR application_id % 2 = 0),
c1 AS (SELECT * FROM c0 UNION ALL SELECT concat('hire-', s.id), s.application_id, 'accepted', e.occurred_at FROM oa JOIN subject s USING (application_id, idx) JOIN stage_event e ON e.id = s.id
  WHERE s.subject <> 'Welcome to our newsletter' AND s.application_id NOT IN (SELECT application_id FROM c0 WHERE stage = 'accepted')),
c2 AS (SELECT *, stage IN ('accepted', 'declined', 'rejected', 'withdrawn') AS t, CASE stage WHEN 'applied' THEN 0 WHEN 'recruiter_screen' THEN 1 WHEN 'phone_screen' THEN 2 WHEN 'technical' THEN 3 WHEN 'onsite' THEN 4 WHEN 'offer' THEN 5 END AS p FROM c1),
c3 AS (SELECT *, coalesce(bool_or(t) OVER b, false) AS ended, coalesce(max(p) OVER b, -1) AS high FROM c2 WINDOW b AS (PARTITION BY application_id ORDER BY occurred_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, application_id, stage FROM c3 WHERE t OR (NOT ended AND p > high)""",
    ("subject", "stage_event"),
)
add(
    "audit_applications",
    lambda r: cl.audit_applications(r.application, r.application.select("id", F.expr("CASE id % 5 WHEN 1 THEN 'merge' WHEN 2 THEN 'delete' ELSE 'keep' END").alias("verdict"), F.min("id").over(Window.partitionBy("company_id")).alias("target"))),
    """, v AS (SELECT id, company_id, id % 5 AS k, min(id) OVER (PARTITION BY company_id) AS target, count(*) OVER (PARTITION BY company_id) AS n FROM application)
SELECT id, CASE k WHEN 1 THEN 'merge' ELSE 'delete' END AS action, CASE WHEN k = 1 THEN target END AS target FROM v WHERE n > 1 AND (k = 2 OR (k = 1 AND target % 5 NOT IN (1, 2)))""",
)
add(
    "audit_companies",
    lambda r: cl.audit_companies(r.company, r.company.select("id", F.expr("CASE id % 7 WHEN 0 THEN 'junk' WHEN 1 THEN 'newsletter' WHEN 2 THEN 'person' WHEN 3 THEN 'misnamed' WHEN 4 THEN 'duplicate' ELSE 'fine' END").alias("verdict"), (F.col("id") - F.expr("CASE WHEN id % 2 = 0 THEN 1 ELSE 3 END")).alias("target"), F.expr("CASE WHEN id % 3 = 0 THEN ' ' WHEN id % 3 = 1 THEN canonical_name ELSE concat(' N ', canonical_name) END").alias("name"))),
    """SELECT id, CASE id % 7 WHEN 0 THEN 'delete' WHEN 1 THEN 'delete' WHEN 4 THEN 'merge' ELSE 'rename' END AS action, CASE WHEN id % 7 = 4 THEN id - CASE WHEN id % 2 = 0 THEN 1 ELSE 3 END END AS target, CASE WHEN id % 7 IN (2, 3) THEN 'N ' || canonical_name END AS name
FROM company WHERE id % 7 IN (0, 1) OR (id % 7 IN (2, 3) AND id % 3 = 2) OR (id % 7 = 4 AND id % 2 = 0)""",
)
add(
    "read_messages", lambda r: cl.read(r.subject.select("id", "subject"), lambda pdf: pdf.assign(label=pdf["subject"].str.contains("offer|Welcome").map({True: "positive", False: "negative"}))[["id", "label"]], "id string, label string").groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN contains(subject, 'offer') OR contains(subject, 'Welcome') THEN 'positive' ELSE 'negative' END AS label, count(*) AS n FROM subject GROUP BY 1",
)
add(
    "audit_plan",
    lambda r: cl.audit_plan(r.message, r.message.select("id", F.expr("direction = 'inbound'").alias("belongs"), (F.col("company_id") + 1).alias("target")), r.message.select("id", F.expr("length(sender_domain) > 10").alias("belongs"), (F.col("company_id") + F.expr("CASE WHEN classified_by IS NULL THEN 2 ELSE 1 END")).alias("target")), r.correspondence.filter("known_contact OR bulk").select("id", F.lit("thread").alias("evidence"))),
    """SELECT m.id, CASE WHEN m.classified_by IS NOT NULL AND (known_contact OR bulk) THEN 'relink' ELSE 'unlink' END AS action, CASE WHEN m.classified_by IS NOT NULL AND (known_contact OR bulk) THEN m.company_id + 1 END AS target
FROM message m JOIN correspondence c USING (id) WHERE m.direction <> 'inbound' AND length(m.sender_domain) <= 10""",
)
