"""Queries of stage folds, rules and normalisation with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import normalize as nz
from ledgerline.operators import rules as ru
from ledgerline.operators import stages as st

from .adapters import record
from .sql import TERMINAL, over_record

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, build, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(record(spark, sf_dir))
    ORACLES[name] = over_record(sql).replace("WITH ", "WITH RECURSIVE ", 1)


def add_table(name: str, table: str, build, sql: str) -> None:
    """A query over one test table."""
    QUERIES[name] = lambda spark, sf_dir: build(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    ORACLES[name] = sql


_E = ["id", "application_id", "stage", "occurred_at"]
add("collapse_runs", lambda r: st.collapse_runs(r.stage_event.select(*_E)), "SELECT id, application_id, stage, occurred_at FROM (SELECT *, lag(stage) OVER (PARTITION BY application_id ORDER BY occurred_at, id) AS b FROM stage_event) WHERE b IS DISTINCT FROM stage")
_PROGRESS = "CASE stage WHEN 'applied' THEN 0 WHEN 'recruiter_screen' THEN 1 WHEN 'phone_screen' THEN 2 WHEN 'technical' THEN 3 WHEN 'onsite' THEN 4 WHEN 'offer' THEN 5 END"


def _windows(source: str, name: str) -> str:
    """CTEs that resolve windows, by stepping through each application's events."""
    return f""", n{name} AS (SELECT id, application_id, stage, occurred_at, row_number() OVER (PARTITION BY application_id ORDER BY occurred_at, id) AS n, stage IN {TERMINAL} AS t,
  {_PROGRESS} AS p FROM {source}),
walk{name} AS (SELECT application_id, n, CASE WHEN NOT t THEN occurred_at END AS began, 0 AS ends FROM n{name} WHERE n = 1
  UNION ALL SELECT e.application_id, e.n, CASE WHEN e.t THEN NULL WHEN w.began IS NULL OR epoch(e.occurred_at - w.began) > 86400 THEN e.occurred_at ELSE w.began END, w.ends + CASE WHEN e.t THEN 1 ELSE 0 END
  FROM walk{name} w JOIN n{name} e ON e.application_id = w.application_id AND e.n = w.n + 1),
{name} AS (SELECT id, application_id, stage, occurred_at FROM n{name} WHERE t UNION ALL
  SELECT id, application_id, stage, began FROM (SELECT e.id, e.application_id, e.stage, w.began, row_number() OVER (PARTITION BY e.application_id, w.began, w.ends ORDER BY e.p DESC, e.n) AS k
    FROM n{name} e JOIN walk{name} w ON w.application_id = e.application_id AND w.n = e.n WHERE NOT e.t) WHERE k = 1)"""


add("resolve_windows", lambda r: st.resolve_windows(r.stage_event.select(*_E)), _windows("stage_event", "resolved") + " SELECT * FROM resolved")
_RUN = "SELECT id, application_id, stage, occurred_at FROM (SELECT *, lag(stage) OVER (PARTITION BY application_id ORDER BY occurred_at, id) AS b FROM {0}) WHERE b IS DISTINCT FROM stage"
add("timeline_claims", lambda r: st.timeline(r.stage_event), f", once AS ({_RUN.format('stage_event')})" + _windows("once", "resolved") + " " + _RUN.format("resolved"))
add(
    "forward_order", lambda r: st.forward_order(r.stage_event.select(*_E)),
    f"""SELECT id, application_id, stage, occurred_at FROM (SELECT *, coalesce(bool_or(t) OVER b, false) AS ended, coalesce(max(p) OVER b, -1) AS high FROM (
  SELECT *, stage IN {TERMINAL} AS t, {_PROGRESS} AS p FROM stage_event) WINDOW b AS (PARTITION BY application_id ORDER BY occurred_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE t OR (NOT ended AND p > high)""",
)
add("latest_batch", lambda r: st.latest_batch(r.stage_event).select("id", "application_id", "derived_at"), "SELECT id, application_id, derived_at FROM (SELECT *, max(derived_at) OVER (PARTITION BY application_id) AS m FROM stage_event) WHERE derived_at IS NOT DISTINCT FROM m")
add(
    "terminal_outcome", lambda r: st.terminal_outcome(r.application, st.latest_batch(r.stage_event)),
    f"""SELECT a.id AS application_id, CASE WHEN c.n > 0 THEN c.claimed ELSE a.outcome END AS outcome FROM application a LEFT JOIN (
  SELECT application_id, count(*) AS n, (list(stage ORDER BY occurred_at DESC, id DESC) FILTER (stage IN {TERMINAL}))[1] AS claimed FROM (
    SELECT *, max(derived_at) OVER (PARTITION BY application_id) AS m FROM stage_event) WHERE derived_at IS NOT DISTINCT FROM m GROUP BY 1) c ON c.application_id = a.id""",
)
_RE = lambda column, pattern: f"regexp_matches({column}, '{pattern}')"
ONBOARDING = (
    f"""SELECT application_id, min(idx) AS idx FROM (SELECT *, bool_or({_RE('subject', nz.CORROBORATION)}) OVER (PARTITION BY application_id ORDER BY idx) AS so_far FROM subject)
WHERE NOT {_RE('subject', nz.NOT_ONBOARDING)} AND ({_RE('subject', nz.ONBOARDING)} OR ({_RE('subject', nz.AMBIGUOUS)} AND so_far)) GROUP BY 1"""
)
add("onboarding_accepted", lambda r: st.accepted_index(r.subject), ONBOARDING)
add(
    "stage_conflicts", lambda r: st.stage_conflicts(r.stage_event.select(*_E)),
    f"""SELECT id, application_id, stage, occurred_at FROM (SELECT *, min(occurred_at) FILTER (stage IN {TERMINAL}) OVER (PARTITION BY application_id ORDER BY occurred_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM stage_event)
WHERE stage NOT IN {TERMINAL} AND occurred_at >= e""",
)
add(
    "closed_applications", lambda r: st.close_applications(r.application, r.stage_event).select("id", "ended_at"),
    f"""SELECT a.id, CASE WHEN e.at_ >= a.started_at THEN e.at_ END AS ended_at FROM application a LEFT JOIN (SELECT application_id, min(occurred_at) AS at_ FROM stage_event WHERE stage IN {TERMINAL} GROUP BY 1) e ON e.application_id = a.id""",
)
add(
    "conversation_application",
    lambda r: st.conversation_application(r.review_queue.join(r.message.select(F.col("id").alias("message_id"), "company_id"), "message_id").select(F.col("id").alias("conversation_id"), "company_id", F.col("created_at").alias("occurred_at")), r.application.join(r.message.groupBy(F.col("application_id").alias("id")).agg(F.max("sent_at").alias("last_at")), "id")),
    """SELECT conversation_id, application_id FROM (SELECT q.id AS conversation_id, a.id AS application_id, row_number() OVER (PARTITION BY q.id ORDER BY NOT (q.created_at BETWEEN a.started_at AND l.last_at), abs(epoch_us(q.created_at) - epoch_us(l.last_at)), a.id) AS k
  FROM review_queue q JOIN message m ON m.id = q.message_id JOIN application a ON a.company_id = m.company_id JOIN (SELECT application_id, max(sent_at) AS last_at FROM message GROUP BY 1) l ON l.application_id = a.id) WHERE k = 1""",
)
add(
    "stage_evidence", lambda r: r.subject.select("id", *[nz.is_evidence(F.lit(s), F.col("subject"), F.col("sender"), F.col("direction")).alias(s) for s in ("offer", "accepted")], nz.welcome_names(F.col("subject"), F.lit("Acme Robotics Inc")).alias("welcome")),
    f"""SELECT id, {_RE('subject', nz.OFFER_EVIDENCE)} AND (direction <> 'outbound' OR {_RE('subject', nz.PAPERWORK)}) AND (NOT {_RE('sender', nz.ESIGN_SENDER)} OR {_RE('subject', nz.ESIGN_EVIDENCE)}) AS offer,
  NOT {_RE('subject', nz.CALENDAR_ANSWER)} AND (NOT {_RE('sender', nz.ESIGN_SENDER)} OR {_RE('subject', nz.ESIGN_EVIDENCE)}) AS accepted,
  NOT {_RE('subject', nz.WELCOME)} OR contains(lower(subject), 'acme') OR contains(lower(subject), 'robotics') AS welcome FROM subject""",
)
# rules
_EFFECTIVE = "SELECT r.match_type, r.value, coalesce({0}.verdict, {1}.verdict) AS verdict, r.category, coalesce({0}.company_id, {1}.company_id) AS company_id, r.source FROM sender_rule r LEFT JOIN sender_category c ON c.category = r.category"
add("rules_for_classifier", lambda r: ru.effective_rules(r.sender_rule, r.sender_category), _EFFECTIVE.format("c", "r"))
add("rules_listing", lambda r: ru.effective_rules(r.sender_rule, r.sender_category, category_first=False), _EFFECTIVE.format("r", "c"))


def _matched(r):
    addressed = r.correspondence.withColumn("addresses", F.array("a1", "a2"))
    return addressed.join(ru.match_rules(addressed.select("id", "addresses"), ru.effective_rules(r.sender_rule, r.sender_category)), "id", "left")


_MATCHED = f""", eff AS ({_EFFECTIVE.format('c', 'r')}),
addr AS (SELECT id, 0 AS pos, lower(a1) AS address FROM correspondence UNION ALL SELECT id, 1, lower(a2) FROM correspondence),
hit AS (SELECT id, pos, match_type, value, verdict, company_id, category, 0 AS len FROM addr JOIN eff ON match_type = 'address' AND value = address
  UNION ALL SELECT id, pos, match_type, value, verdict, company_id, category, -length(value) FROM addr JOIN eff ON match_type = 'domain' AND (split_part(address, '@', 2) = value OR ends_with(split_part(address, '@', 2), '.' || value))),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY match_type, pos, len) AS k FROM hit) WHERE k = 1)"""
add("match_rules", lambda r: _matched(r).select("id", "verdict", "company_id", "category", "match_type", "matched").filter("match_type IS NOT NULL"), _MATCHED + " SELECT id, verdict, company_id, category, match_type, value AS matched FROM best")
add(
    "prefilter_verdict", lambda r: _matched(r).select("id", ru.verdict(F.col("verdict"), F.col("known_contact"), F.col("thread_positive"), F.array_compact(F.array("label")), F.col("bulk")).alias("v")).select("id", "v.status", F.array_join("v.reasons", ",").alias("reasons")),
    _MATCHED + """ SELECT c.id, CASE WHEN coalesce(verdict = 'positive', false) OR known_contact OR thread_positive THEN 'positive' WHEN verdict = 'undecided' THEN 'undecided' WHEN coalesce(verdict = 'negative', false) OR label IS NOT NULL THEN 'negative' ELSE 'undecided' END AS status,
  concat_ws(',', CASE WHEN known_contact THEN 'known-contact' END, CASE WHEN thread_positive THEN 'thread-positive' END, 'learned:' || verdict, 'label:' || label, CASE WHEN bulk THEN 'bulk-header' END) AS reasons FROM correspondence c LEFT JOIN best USING (id)""",
)
add(
    "exploration_sample", lambda r: r.message.select("id", "sender_domain").filter(nz.explored(F.lit("domain"), F.col("sender_domain"), F.col("id"))),
    """SELECT id, sender_domain FROM (SELECT id, sender_domain, md5(concat('domain:', lower(sender_domain), ':', id)) AS h FROM message) WHERE CAST(('0x' || h)::UHUGEINT % 10000 AS INTEGER) < 200""".replace("('0x' || h)::UHUGEINT % 10000", "((((('0x' || h[1:8])::HUGEINT % 10000 * 4294967296 + ('0x' || h[9:16])::HUGEINT) % 10000 * 4294967296 + ('0x' || h[17:24])::HUGEINT) % 10000 * 4294967296 + ('0x' || h[25:32])::HUGEINT) % 10000)"),
)
add("fanout_preview", lambda r: ru.fanout(r.message.withColumn("sender_domain", F.concat(F.lit("mail."), "sender_domain")), "domain", "s7.example"), "SELECT count(*) FILTER (classified_by IS NULL) AS backlog, count(*) FILTER (classified_by IS NOT NULL) AS classified FROM message WHERE sender_domain = 's7.example'")


def _gaps(r):
    return r.message.withColumn("company_id", F.when(F.col("classified_by").eqNullSafe(F.lit("model-x")), F.col("company_id"))).withColumn("application_id", F.when(F.col("company_id").isNotNull(), F.col("application_id")))


_GAPS = ", gap AS (SELECT id, thread_id, sent_at, sender_domain, CASE WHEN classified_by = 'model-x' THEN company_id END AS company_id, CASE WHEN classified_by = 'model-x' THEN application_id END AS application_id FROM message)"
add("thread_context", lambda r: ru.thread_context(_gaps(r)), _GAPS + " SELECT thread_id, company_id, application_id FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY sent_at DESC, id DESC) AS k FROM gap WHERE company_id IS NOT NULL) WHERE k = 1")
add("thread_carry", lambda r: ru.carry_threads(_gaps(r)).select("id", "company_id", "application_id"), _GAPS + " SELECT id, coalesce(gap.company_id, t.company_id) AS company_id, coalesce(gap.application_id, t.application_id) AS application_id FROM gap LEFT JOIN (SELECT thread_id, company_id, application_id FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY sent_at DESC, id DESC) AS k FROM gap WHERE company_id IS NOT NULL) WHERE k = 1) t USING (thread_id)")
add(
    "domain_carry", lambda r: ru.domain_carry(_gaps(r).withColumn("sender_domain", F.concat(F.lit("mail."), F.replace("sender_domain", F.lit("s"), F.lit("co")))), r.company),
    _GAPS + " SELECT gap.id, c.id AS company_id FROM gap JOIN company c ON c.domain = replace(sender_domain, 's', 'co') WHERE gap.company_id IS NULL",
)
add(
    "unresolved_correspondents", lambda r: ru.unresolved_correspondents(r.message.filter("classified_by IS NULL").select("id", F.concat(F.lit("hr@"), "sender_domain").alias("sender_address"), F.when(F.col("sender_domain").like("s1%"), "gmail.com").otherwise(F.col("sender_domain")).alias("sender_domain"), F.col("thread_id").alias("subject"), "sent_at")),
    """SELECT kind, value, count(*) AS n, arg_max(thread_id, sent_at || id) AS subject FROM (SELECT *, CASE WHEN sender_domain LIKE 's1%' THEN 'address' ELSE 'domain' END AS kind, CASE WHEN sender_domain LIKE 's1%' THEN 'hr@' || sender_domain ELSE sender_domain END AS value FROM message WHERE classified_by IS NULL)
GROUP BY 1, 2 ORDER BY n DESC, kind, value LIMIT 50""",
)
add(
    "review_ranking", lambda r: ru.review_ranking(r.review_queue, r.message, r.sender_rule),
    """SELECT q.id, q.message_id, q.reason, m.sender_domain, coalesce(s.n, 0) * CASE WHEN EXISTS (SELECT 1 FROM sender_rule u WHERE u.match_type = 'domain' AND u.verdict = 'undecided' AND u.value = m.sender_domain) THEN 2 ELSE 1 END AS impact, q.created_at
FROM review_queue q JOIN message m ON m.id = q.message_id LEFT JOIN (SELECT sender_domain, count(*) AS n FROM message WHERE company_id IS NULL OR classified_by IS NULL GROUP BY 1) s ON s.sender_domain = m.sender_domain WHERE q.status = 'pending'""",
)
add(
    "teach_positive", lambda r: ru.teach_positive(r.message.filter("classified_by = 'model-x'").join(r.company.select(F.col("id").alias("company_id"), "kind"), "company_id").select("id", F.col("sender_domain").alias("domain"), "company_id", "kind", F.col("sent_at").alias("at")), r.sender_rule),
    """, reading AS (SELECT m.id, m.sender_domain AS domain, m.company_id, m.sent_at, row_number() OVER w AS n, first_value(m.company_id) OVER w AS first FROM message m JOIN company c ON c.id = m.company_id
  WHERE m.classified_by = 'model-x' AND c.kind <> 'agency' WINDOW w AS (PARTITION BY m.sender_domain ORDER BY m.sent_at, m.id)),
by_domain AS (SELECT domain, any_value(first) AS first, bool_or(n > 1 AND company_id = first) AS again FROM reading GROUP BY 1),
rule AS (SELECT value AS domain, verdict, company_id, source FROM sender_rule WHERE match_type = 'domain')
SELECT domain, first AS company_id, CASE WHEN again THEN 'positive' ELSE 'undecided' END AS verdict FROM by_domain WHERE domain NOT IN (SELECT domain FROM rule)
UNION ALL SELECT domain, company_id, 'positive' FROM rule WHERE verdict = 'undecided' AND source <> 'human' AND EXISTS (SELECT 1 FROM reading WHERE reading.domain = rule.domain AND reading.company_id = rule.company_id)""",
)
add(
    "teach_negative", lambda r: ru.teach_negative(r.correspondence.select("id", F.col("a2").alias("sender_address")), r.sender_rule, "me@s150.example"),
    """SELECT DISTINCT CASE WHEN d = 's150.example' THEN 'address' ELSE 'domain' END AS match_type, CASE WHEN d = 's150.example' THEN a2 ELSE d END AS value FROM (SELECT a2, split_part(a2, '@', 2) AS d FROM correspondence)
WHERE NOT EXISTS (SELECT 1 FROM sender_rule u WHERE (u.match_type = 'domain' AND u.value = d) OR (u.match_type = 'address' AND u.value = a2))""",
)
add(
    "distillation_candidates", lambda r: ru.distillation_candidates(r.message, r.sender_rule.filter("source = 'human'")),
    """SELECT sender_domain, count(*) AS messages, count(company_id) AS linked, count(DISTINCT company_id) AS companies, count(DISTINCT thread_id) AS threads FROM message WHERE classified_by LIKE 'model%'
AND sender_domain NOT IN (SELECT value FROM sender_rule WHERE match_type = 'domain' AND source = 'human') GROUP BY 1""",
)
# normalisation
_SUFFIX = "|".join(nz.SUFFIXES)
_NORM = f"trim(regexp_replace(' ' || trim(regexp_replace(lower({{0}}), '[^a-z0-9]+', ' ', 'g')), '( ({_SUFFIX}))+$', ''))"
_NAME = "concat(replace(replace(s_name, 'Supplier', 'Acme'), '#', ' '), CASE s_suppkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Technologies Group' WHEN 2 THEN ' Co' ELSE '' END)"
add_table("normalise_company", "supplier", lambda t: t.select("s_suppkey", nz.normalise_company(F.expr(_NAME)).alias("name"), F.array_join(nz.alias_forms(F.expr(_NAME), F.expr("concat('acme-', CAST(s_suppkey % 9 AS STRING), '.io')")), "|").alias("aliases")),
    f"""SELECT s_suppkey, {_NORM.format(_NAME)} AS name, array_to_string(list_distinct_ordered, '|') AS aliases FROM (SELECT *, [x FOR x, i IN f IF list_position(f, x) = i] AS list_distinct_ordered FROM (SELECT s_suppkey, s_name, [{_NORM.format(_NAME)}, replace({_NORM.format(_NAME)}, ' ', ''), 'acme ' || (s_suppkey % 9), 'acme' || (s_suppkey % 9)] AS f FROM supplier))""")
add_table("normalise_domain", "pages", lambda t: t.select("page_id", nz.normalise_domain(F.col("url")).alias("domain"), F.array_join(nz.suffixes(nz.normalise_domain(F.col("url"))), "|").alias("parents"), nz.generic(nz.normalise_domain(F.col("url"))).alias("generic")),
    """SELECT page_id, d AS domain, array_to_string(list_transform(range(1, len(string_split(d, '.'))), lambda i: array_to_string(string_split(d, '.')[i:], '.')), '|') AS parents, false AS generic
FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '/.*$', ''), '^www\\.', '') AS d FROM pages)""")  # fmt: skip
_TITLE = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
add_table("same_role", "part", lambda t: t.select("p_partkey", nz.same_role(F.col("p_name"), F.concat(F.lit("Senior "), F.col("p_name"))).alias("same"), nz.same_role(F.col("p_name"), F.col("p_type")).alias("other"), nz.same_role(F.lit(None).cast("string"), F.col("p_type")).alias("missing")),
    f"""SELECT p_partkey, len(a) > 0 AS same, len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.6 AS other, false AS missing
FROM (SELECT p_partkey, list_distinct(list_filter({_TITLE.format('p_name')}, lambda w: NOT list_contains({list(nz.TITLE_STOPWORDS)}, w))) AS a, list_distinct(list_filter({_TITLE.format('p_type')}, lambda w: NOT list_contains({list(nz.TITLE_STOPWORDS)}, w))) AS b FROM part)""")  # fmt: skip
add_table("html_text", "pages", lambda t: t.select("page_id", F.md5(nz.body_text(F.lit(None).cast("string"), F.col("html")).cast("binary")).alias("text")),
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(x, '\r\n?', chr(10), 'g'), chr(160), ' '), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+$', '')) AS text FROM (
  SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&') AS x FROM pages)""")  # fmt: skip
add_table("terminal_language", "documents", lambda t: t.select("doc_id", nz.looks_terminal(F.lit(None).cast("string"), F.col("text")).alias("terminal")),
    "SELECT doc_id, " + " OR ".join(f"contains(lower(coalesce(text, '')), '{x}')" for x in nz.TERMINAL_TERMS) + " AS terminal FROM documents")
add_table("shared_words", "documents", lambda t: t.select("doc_id", F.array_join(nz.shared_words(F.lit("of the stupid license version under token"), F.col("text")), ",").alias("shared")),
    "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z'']{2,}'), lambda w: w IN ('stupid', 'license', 'version', 'token', 'under')))), ',') AS shared FROM documents")
