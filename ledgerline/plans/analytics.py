"""Queries of the analytic operators with their oracle SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ledgerline.operators import briefing, funnel, lists, scope

from .adapters import record
from .sql import GHOSTED, TAG, TERMINAL, TURN, WHOLE_DAYS, over_record

QUERIES: dict = {}
ORACLES: dict = {}

SINCE, UNTIL = datetime(1998, 1, 1), datetime(1998, 12, 31)
_WINDOW = "EXISTS (SELECT 1 FROM message w WHERE w.{1} = {0} AND w.sent_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31')"


def add(name: str, build, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(record(spark, sf_dir))
    ORACLES[name] = over_record(sql)


add("latest_stage", scope.latest_stage, "SELECT * FROM ls")
add("latest_stage_of_company", lambda r: scope.latest_stage(r, "company_id"), "SELECT * FROM lsc")
add("current_generation", scope.current_events, "SELECT * FROM cur")
add("application_facts", funnel.application_facts, "SELECT * FROM facts")
add("application_facts_in_window", lambda r: funnel.application_facts(r, SINCE, UNTIL), f"SELECT * FROM facts WHERE {_WINDOW.format('facts.application_id', 'application_id')}")
add("confirmed_rounds", funnel.confirmed_rounds, "SELECT * FROM rounds")
add("confirmed_rounds_in_window", lambda r: funnel.confirmed_rounds(r, SINCE, UNTIL), f"SELECT * FROM rounds WHERE {_WINDOW.format('rounds.application_id', 'application_id')}")
_ROUND = "CASE stage WHEN 'recruiter_screen' THEN 0.5 WHEN 'phone_screen' THEN 0.5 WHEN 'technical' THEN 1.0 ELSE 3.0 END"
_PREP = "CASE stage WHEN 'recruiter_screen' THEN 0.5 WHEN 'phone_screen' THEN 2.0 WHEN 'technical' THEN 4.0 ELSE 8.0 END"
add("confirmed_rounds_hours", funnel.round_hours, f"SELECT stage, count(*) AS rounds, CAST(sum({_ROUND}) AS DOUBLE) AS interview_hours, CAST(sum({_PREP}) AS DOUBLE) AS prep_hours FROM rounds GROUP BY stage")
add("estimated_hours", funnel.total_hours, f"SELECT count(*) AS rounds, count(DISTINCT date_trunc('month', d)) AS months, CAST(sum({_ROUND}) AS DOUBLE) AS interview_hours, CAST(sum({_PREP}) AS DOUBLE) + 8.0 * count(DISTINCT date_trunc('month', d)) AS prep_hours FROM rounds")
add("engaged_applications", funnel.engaged, "SELECT * FROM engaged")
add("replied_companies", funnel.replied, "SELECT count(first_out) AS reached_out, count(*) FILTER (last_in > first_out) AS replied FROM talk")
add("outcome_counts", funnel.outcomes, "SELECT coalesce(outcome, 'open') AS outcome, count(*) AS applications FROM facts GROUP BY 1")
add(
    "funnel_stats", funnel.stats,
    f"""SELECT count(*) AS applications, count(DISTINCT company_id) AS companies, count(DISTINCT company_id) FILTER (eng) AS engaged,
  count(DISTINCT company_id) FILTER (had_offer) AS offers, count(*) FILTER (outcome = 'rejected') AS rejections,
  count(*) FILTER (live AND last_dir = 'inbound') AS court_yours, count(*) FILTER (live AND last_dir = 'outbound') AS court_theirs,
  (SELECT count(*) FROM rounds) AS interviews, (SELECT count(DISTINCT company_id) FROM rounds) AS interviewed,
  (SELECT count(*) FILTER (last_in > first_out) FROM talk) AS replied,
  (SELECT count(*) FILTER (last_in > first_out) / count(first_out) FROM talk) AS response_rate, count(*) FILTER (ghost AND eng) / count(*) FILTER (eng) AS ghost_rate
FROM (SELECT *, NOT coalesce(outcome IN {TERMINAL}, false) AND NOT coalesce(latest_stage IN {TERMINAL}, false) AND NOT ghost AND eng AS live FROM (
  SELECT facts.*, e.application_id IS NOT NULL AS eng, {GHOSTED} AS ghost FROM facts LEFT JOIN engaged e ON e.application_id = facts.application_id, clock))""",
)
_HALVES = "count(*) FILTER ({0} >= clock_at - INTERVAL 30 DAY) AS {1}_30d, count(*) FILTER ({0} >= clock_at - INTERVAL 60 DAY AND {0} < clock_at - INTERVAL 30 DAY) AS {1}_prev_30d"
add("momentum", funnel.momentum, f"SELECT * FROM (SELECT {_HALVES.format('d', 'rounds')} FROM rounds, clock), (SELECT {_HALVES.format('sent_at', 'outbound')} FROM message, clock WHERE direction = 'outbound' AND company_id IS NOT NULL)")
add(
    "reply_lag", funnel.reply_lag,
    """SELECT median(epoch(first_in - first_out) / 86400.0) AS reply_lag_days FROM (
  SELECT a.id, f.first_out, min(m.sent_at) AS first_in FROM application a JOIN (SELECT company_id, min(sent_at) AS first_out FROM message WHERE direction = 'outbound' GROUP BY 1) f USING (company_id)
  JOIN message m ON m.company_id = a.company_id AND m.direction = 'inbound' AND m.sent_at > f.first_out GROUP BY 1, 2)""",
)
add(
    "weeks_to_offer", funnel.weeks_to_offer,
    """SELECT median(epoch(offer_at - began) / 604800.0) AS weeks_to_offer FROM (
  SELECT o.company_id, offer_at, min(sent_at) AS began FROM (SELECT company_id, min(occurred_at) AS offer_at FROM cur WHERE stage = 'offer' GROUP BY 1) o
  JOIN message m ON m.company_id = o.company_id AND m.sent_at <= o.offer_at GROUP BY 1, 2)""",
)
add(
    "in_flight_count", funnel.in_flight_count,
    """SELECT count(*) AS in_flight FROM ls JOIN application a ON a.id = ls.application_id WHERE ls.stage IN ('recruiter_screen', 'phone_screen', 'technical', 'onsite', 'offer') AND a.outcome IS NULL
  AND (ls.stage <> 'recruiter_screen' OR EXISTS (SELECT 1 FROM message m WHERE m.company_id = a.company_id AND m.direction = 'outbound'))""",
)
_AWAITING = f"""SELECT c.id AS company_id, c.canonical_name, c.kind, lmc.application_id, a.role_title, lsc.stage, lmc.sent_at, {WHOLE_DAYS.format('lmc.sent_at')} AS silent_days
FROM lmc JOIN company c ON c.id = lmc.company_id LEFT JOIN application a ON a.id = lmc.application_id LEFT JOIN lsc ON lsc.company_id = c.id, clock
WHERE lmc.direction = 'inbound' AND lmc.sent_at >= clock_at - INTERVAL {{0}} DAY AND (lsc.stage IS NULL OR lsc.stage NOT IN {TERMINAL}) ORDER BY lmc.sent_at DESC, c.id LIMIT 25"""
add("awaiting_reply", briefing.awaiting_reply, _AWAITING.format(120))
add("awaiting_reply_backlog", lambda r: briefing.awaiting_reply(r, within_days=None, limit=None), _AWAITING.format(100000).replace(" LIMIT 25", ""))
add(
    "going_cold", lambda r: briefing.going_cold(r, after_days=400, lead_days=386),
    f"""SELECT c.id AS company_id, c.canonical_name, c.kind, a.id AS application_id, a.role_title, ls.stage, lm.sent_at, {WHOLE_DAYS.format('lm.sent_at')} AS silent_days
FROM application a JOIN company c ON c.id = a.company_id JOIN lm ON lm.application_id = a.id LEFT JOIN ls ON ls.application_id = a.id, clock
WHERE lm.direction = 'outbound' AND a.outcome IS NULL AND (ls.stage IS NULL OR ls.stage NOT IN {TERMINAL}) AND lm.sent_at < clock_at - INTERVAL 14 DAY AND lm.sent_at >= clock_at - INTERVAL 400 DAY
ORDER BY lm.sent_at, a.id LIMIT 25""",
)
add(
    "in_flight", briefing.in_flight,
    f"""SELECT c.id AS company_id, c.canonical_name, c.kind, a.id AS application_id, a.role_title, ls.stage, lm.sent_at, ls.occurred_at, {WHOLE_DAYS.format('ls.occurred_at')} AS silent_days
FROM ls JOIN application a ON a.id = ls.application_id JOIN company c ON c.id = a.company_id LEFT JOIN lm ON lm.application_id = a.id, clock
WHERE ls.stage IN ('recruiter_screen', 'phone_screen', 'technical', 'onsite', 'offer') AND a.outcome IS NULL ORDER BY ls.occurred_at DESC, a.id LIMIT 25""",
)
_RANK = "list_position(['applied', 'recruiter_screen', 'phone_screen', 'technical', 'onsite', 'rejected', 'withdrawn', 'offer', 'declined', 'accepted'], stage)"
add(
    "offers", briefing.offers,
    f""", peak AS (SELECT application_id, max({_RANK}) AS rank FROM cur GROUP BY 1),
offered AS (SELECT application_id FROM cur WHERE stage = 'offer' UNION SELECT application_id FROM cur WHERE stage IN ('accepted', 'declined')
  AND EXISTS (SELECT 1 FROM cur x WHERE x.application_id = cur.application_id AND x.stage IN ('recruiter_screen', 'phone_screen', 'technical', 'onsite'))),
answers AS (SELECT company_id, stage, {_RANK} AS rank FROM cur WHERE stage = 'offer' OR (stage IN ('accepted', 'declined')
  AND NOT EXISTS (SELECT 1 FROM cur x WHERE x.stage = 'offer' AND x.evidence_message_id = cur.evidence_message_id))),
status AS (SELECT company_id, arg_max(stage, rank) AS stage FROM answers GROUP BY 1)
SELECT company_id, canonical_name, kind, application_id, role_title, coalesce(company_stage, stage) AS status, sent_at FROM (
  SELECT c.id AS company_id, c.canonical_name, c.kind, a.id AS application_id, a.role_title, status.stage AS company_stage, ls.stage, lm.sent_at,
    row_number() OVER (PARTITION BY c.id ORDER BY peak.rank DESC NULLS LAST, a.role_title IS NULL, ls.occurred_at ASC NULLS LAST, a.id) AS rn
  FROM offered o JOIN application a ON a.id = o.application_id JOIN company c ON c.id = a.company_id AND c.kind <> 'agency' LEFT JOIN ls ON ls.application_id = a.id
  LEFT JOIN lm ON lm.application_id = a.id LEFT JOIN peak ON peak.application_id = a.id LEFT JOIN status ON status.company_id = c.id) WHERE rn = 1""",
)
add(
    "rejections", briefing.rejections,
    """SELECT c.id AS company_id, c.canonical_name, a.id AS application_id, ls.stage, ls.occurred_at FROM application a JOIN oe ON oe.application_id = a.id
JOIN company c ON c.id = a.company_id AND c.kind <> 'agency' LEFT JOIN ls ON ls.application_id = a.id
WHERE (CASE WHEN a.derived_at IS NOT NULL THEN oe.stage ELSE coalesce(a.outcome, oe.stage) END) = 'rejected' ORDER BY ls.occurred_at DESC NULLS LAST, a.id LIMIT 200""",
)
_COMPANIES = f"""companies AS (SELECT c.id AS company_id, c.canonical_name, c.domain, c.kind, coalesce(m.n, 0) AS message_count, coalesce(a.n, 0) AS application_count, m.last_touch,
  lmc.direction AS last_direction, lsc.stage AS latest_stage, {TURN.replace('direction', 'lmc.direction')} AS turn
  FROM company c LEFT JOIN (SELECT company_id, count(*) AS n, max(sent_at) AS last_touch FROM message GROUP BY 1) m ON m.company_id = c.id
  LEFT JOIN (SELECT company_id, count(*) AS n FROM application GROUP BY 1) a ON a.company_id = c.id
  LEFT JOIN lmc ON lmc.company_id = c.id LEFT JOIN lsc ON lsc.company_id = c.id)"""
add("companies", lists.companies, f", {_COMPANIES} SELECT * FROM companies")
add("companies_in_window", lambda r: lists.companies(r, SINCE, UNTIL), f", {_COMPANIES} SELECT * FROM companies WHERE {_WINDOW.format('companies.company_id', 'company_id')}")
add("companies_page", lambda r: lists.page(lists.companies(r), "activity", 20, 40), f", {_COMPANIES} SELECT * FROM companies ORDER BY message_count DESC, company_id LIMIT 20 OFFSET 40")
add(
    "companies_filtered", lambda r: lists.filter_companies(lists.companies(r), scope.as_of(r), search="co1", kind="employer", turn="your_turn", substantive=True, active_within_days=800),
    f", {_COMPANIES} SELECT companies.* FROM companies, clock WHERE (canonical_name ILIKE '%co1%' OR domain ILIKE '%co1%') AND kind = 'employer' AND turn = 'your_turn' AND (message_count >= 2 OR application_count >= 1) AND last_touch >= clock_at - INTERVAL 800 DAY",
)
_MESSAGES = f"""messages AS (SELECT m.id, m.company_id, c.canonical_name, m.application_id, m.direction, m.sent_at, {TAG} AS tag, s.stages IS NOT NULL AS is_evidence, coalesce(s.stages, '') AS stages
  FROM message m LEFT JOIN (SELECT evidence_message_id, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages FROM cur GROUP BY 1) s ON s.evidence_message_id = m.id LEFT JOIN company c ON c.id = m.company_id)"""
add("messages", lists.messages, f", {_MESSAGES} SELECT * FROM messages")
add(
    "messages_within", lambda r: lists.messages(r, recorded=True, within=(r.correspondence.filter("a2 LIKE 'p7@%' OR a2 LIKE 'p8@%'"), r.subject.filter("subject LIKE 'Welcome%'"))),
    f", {_MESSAGES} SELECT * FROM messages WHERE company_id IS NOT NULL AND id IN (SELECT id FROM correspondence WHERE split_part(a2, '@', 1) IN ('p7', 'p8')) AND id IN (SELECT id FROM subject WHERE starts_with(subject, 'Welcome'))",
)
add("messages_filtered", lambda r: lists.messages(r, direction="inbound", tag="model", evidence=True, hide_negative=True, since=SINCE, until=UNTIL), f", {_MESSAGES} SELECT * FROM messages WHERE direction = 'inbound' AND tag = 'model' AND is_evidence AND sent_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31'")
add(
    "home_counts", lists.home_counts,
    """SELECT count(*) AS total, count(*) FILTER (classified_by IS NULL) AS unclassified, count(*) FILTER (classified_by = 'prefilter:negative') AS negative,
  count(*) FILTER (classified_by IS NOT NULL AND company_id IS NOT NULL) AS recorded,
  count(*) FILTER (classified_by IS NOT NULL AND company_id IS NULL AND classified_by <> 'prefilter:negative' AND NOT q) AS not_job_related, count(*) FILTER (q) AS queued
FROM (SELECT *, EXISTS (SELECT 1 FROM review_queue r WHERE r.message_id = message.id AND r.status = 'pending') AS q FROM message)""",
)
add("daily_interviews", lists.daily_activity, "SELECT CAST(d AS DATE) AS day, count(*) AS n FROM rounds GROUP BY 1")
add("daily_messages", lambda r: lists.daily_activity(r, "messages"), "SELECT CAST(sent_at AS DATE) AS day, count(*) AS n FROM message WHERE direction = 'inbound' AND company_id IS NOT NULL GROUP BY 1")
add(
    "activity_calendar", lists.activity_calendar,
    """, ends AS (SELECT CAST(clock_at AS DATE) AS e, CAST(clock_at AS DATE) - 370 AS s FROM clock),
days AS (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS day, s - CAST(dayofweek(s) AS INTEGER) AS grid FROM ends),
n AS (SELECT CAST(d AS DATE) AS day, count(*) AS n FROM rounds GROUP BY 1)
SELECT days.day, CAST((days.day - grid) // 7 AS INTEGER) AS week, CAST(dayofweek(days.day) AS INTEGER) AS weekday, coalesce(n, 0) AS n,
  CASE WHEN n >= 11 THEN 4 WHEN n >= 6 THEN 3 WHEN n >= 3 THEN 2 WHEN n >= 1 THEN 1 ELSE 0 END AS level FROM days LEFT JOIN n ON n.day = days.day""",
)
add(
    "ghosted_applications", lambda r: funnel.application_facts(r).withColumn("ghosted", scope.ghosted(F.col("last_out"), F.col("last_dir"), F.col("latest_stage"), scope.as_of(r))).select("application_id", "ghosted"),
    f"SELECT application_id, {GHOSTED} AS ghosted FROM facts, clock",
)
