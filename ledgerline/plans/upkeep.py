"""Queries of the upkeep of the record, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import normalize as nz
from ledgerline.operators import classify, lists, mutate, quality, search
from ledgerline.operators import reports as rp
from ledgerline.operators import resolve as rs
from ledgerline.operators import rules as ru
from ledgerline.operators import upkeep as up
from ledgerline.sources import envelopes as env

from .adapters import record
from .entities import _NAMED, _named
from .intake import _RUNS, _mail, _runs
from .sql import TERMINAL, over_record

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, build, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(record(spark, sf_dir))
    if sql:
        ORACLES[name] = over_record(sql)


# links and filters
_LINKS = lambda r: r.message.filter("classified_by = 'rule-carry'").select(F.col("id").alias("message_id"), (F.col("company_id") + 1).alias("company_id"))
add("company_mail", lambda r: up.company_mail(r.message, _LINKS(r)), "SELECT company_id, id FROM message UNION SELECT company_id + 1, id FROM message WHERE classified_by = 'rule-carry'")
add("backlog_oldest", lambda r: up.backlog(r.message, 100).select("id", "sent_at"), "SELECT id, sent_at FROM message WHERE classified_by IS NULL ORDER BY sent_at, id LIMIT 100")


def slices(r):
    out = up.backlog(r.message, None, 0, 4)
    for k in (1, 2, 3):
        out = out.unionByName(up.backlog(r.message, None, k, 4))
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("slices"))


add("backlog_slices", slices, "SELECT id, count(*) AS slices FROM message WHERE classified_by IS NULL GROUP BY 1")


def reset_all(r):
    rows = r.message
    for k in range(3):
        rows = mutate.reset_slice(rows, k, 3)
    return rows.select("id", F.col("classified_by").isNull().alias("open"))


add("reset_slices", reset_all, "SELECT id, true AS open FROM message")
_FAMILIES = {"offer": ["offer letter", "docusign"], "start": ["welcome", "payroll"], "visa": ["h-1b", "immigration"]}
_SEEDS = lambda r: r.subject.join(r.correspondence.select("id", "a1", "a2", "label"), "id").join(r.message.select("id", "sent_at"), "id").select("id", "direction", F.array("a2", "a1").alias("addresses"), "subject", F.array("label").alias("labels"), "sent_at")
_LIKE = " OR ".join
_QUIET = "label IS DISTINCT FROM 'CATEGORY_SOCIAL'"
_WORDS = ", ".join(f"CASE WHEN {_QUIET} AND ({_LIKE(f'contains(lower(subject), {chr(39)}{p}{chr(39)})' for p in words)}) THEN '{name}' END" for name, words in _FAMILIES.items())
add(
    "seed_pack", lambda r: _SEEDS(r).select("id", F.array_join(up.seed_pack(["p7@s7.example"], ["s1.example", "s20.example"], _FAMILIES), ",").alias("families")),
    f"""SELECT s.id, array_to_string(list_filter([CASE WHEN s.direction = 'outbound' THEN 'sent' END, CASE WHEN 'p7@s7.example' IN (a2, lower(a1)) THEN 'relay' END,
  CASE WHEN split_part(a2, '@', 2) IN ('s1.example', 's20.example') OR replace(lower(a1), 'mail.', '') IN ('hr@s1.example', 'hr@s20.example') THEN 'system' END, {_WORDS}], lambda x: x IS NOT NULL), ',') AS families
FROM subject s JOIN correspondence USING (id)""",
)
add("residual_pack", lambda r: _SEEDS(r).filter(up.residual("hr@s1.example")).select("id"), f"SELECT id FROM correspondence WHERE lower(a1) = 'hr@s1.example' AND {_QUIET}")
# rules
_BOTH = lambda r: r.sender_rule.filter("match_type = 'domain' AND verdict IN ('positive', 'negative')")
_MAIL = lambda r: r.message.withColumn("addresses", F.array(F.concat(F.lit("x@"), "sender_domain")))
add(
    "fan_out", lambda r: up.fan_out(_MAIL(r), _BOTH(r)).select("id", "company_id", "classified_by"),
    """, u AS (SELECT value, verdict, company_id AS c FROM sender_rule WHERE match_type = 'domain' AND verdict IN ('positive', 'negative'))
SELECT id, CASE WHEN classified_by IS NOT NULL OR verdict IS NULL THEN company_id WHEN verdict = 'positive' THEN c END AS company_id,
  CASE WHEN classified_by IS NOT NULL OR verdict IS NULL THEN classified_by WHEN verdict = 'positive' THEN 'rule:learned' ELSE 'rule:negative' END AS classified_by FROM message LEFT JOIN u ON value = sender_domain""",
)
_TAUGHT = lambda r: r.sender_rule.filter("source = 'llm' OR value LIKE '%9.example'").withColumn("verdict", F.lit("negative")).withColumn("value", F.expr("CASE WHEN value LIKE '%9.example' THEN replace(value, '.example', '.test') ELSE value END"))
add(
    "learn_rules", lambda r: up.learn_rules(r.sender_rule, _MAIL(r), _TAUGHT(r))[0].select("match_type", "value", "verdict", "source"),
    """SELECT match_type, value, CASE WHEN source = 'llm' AND value NOT LIKE '%9.example' THEN 'negative' ELSE verdict END AS verdict, CASE WHEN source = 'llm' AND value NOT LIKE '%9.example' THEN 'human' ELSE source END AS source FROM sender_rule
UNION ALL SELECT match_type, replace(value, '.example', '.test'), 'negative', 'human' FROM sender_rule WHERE value LIKE '%9.example'""",
)
_CANDIDATES = lambda r: ru.distillation_candidates(r.message.withColumn("company_id", F.expr("CASE WHEN sender_domain LIKE 's%5.example' THEN company_id END")), r.sender_rule.limit(0))
add(
    "distilled_rules",
    lambda r: up.distilled(_CANDIDATES(r).select(F.col("sender_domain").alias("domain"), F.expr("CASE length(sender_domain) % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'undecided' ELSE 'positive' END").alias("verdict")), _CANDIDATES(r), r.sender_rule).select("match_type", "value", "verdict", "source"),
    """SELECT match_type, value, verdict, source FROM sender_rule UNION ALL SELECT 'domain', d, CASE length(d) % 3 WHEN 0 THEN 'negative' ELSE 'undecided' END, 'distilled' FROM (SELECT DISTINCT sender_domain AS d FROM message WHERE classified_by LIKE 'model%')
WHERE length(d) % 3 < 2 AND NOT (length(d) % 3 = 0 AND d LIKE 's%5.example') AND d NOT IN (SELECT value FROM sender_rule WHERE match_type = 'domain')""",
)
_PASS = "NOT EXISTS (SELECT 1 FROM sender_rule u WHERE (u.match_type = 'domain' AND u.value = d) OR (u.match_type = 'address' AND u.value = a2))"
add(
    "learning_passes", lambda r: up.learning_passes(r.correspondence.select("id", F.col("a2").alias("address")), r.sender_rule, r.correspondence.filter("bulk").select("id", F.col("a2").alias("sender_address"))),
    f""", c AS (SELECT a2, split_part(a2, '@', 2) AS d, bulk FROM correspondence), t AS (SELECT DISTINCT d FROM c WHERE bulk AND {_PASS}), k AS (SELECT count(*) AS k FROM sender_rule)
SELECT 1 AS pass, (SELECT count(*) FROM c WHERE {_PASS}) AS calls, k AS rules FROM k UNION ALL SELECT 2, (SELECT count(*) FROM c WHERE {_PASS} AND d NOT IN (SELECT d FROM t)), k + (SELECT count(*) FROM t) FROM k""",
)
add("sender_coverage", lambda r: up.sender_coverage(r.correspondence.select("id", F.col("a2").alias("address")), r.sender_rule), f"SELECT count(DISTINCT a2) AS senders, count(DISTINCT a2) FILTER (NOT {_PASS}) AS covered, count(*) AS messages, count(*) FILTER (NOT {_PASS}) AS covered_messages FROM (SELECT a2, split_part(a2, '@', 2) AS d FROM correspondence)")
_RAW = "CASE WHEN verdict IS NULL THEN 'broken' ELSE concat('[{\"match_type\":\"', match_type, '\",\"value\":\" ', upper(value), '\",\"verdict\":\"', verdict, '\"},{\"match_type\":\"list\",\"value\":\"x\",\"verdict\":\"negative\"},{\"match_type\":\"domain\",\"value\":\" \",\"verdict\":\"negative\"}]') END"
add("coerce_rules", lambda r: r.sender_rule.select("match_type", "value", classify.coerce_rules(F.expr(_RAW)).alias("c")).select("match_type", "value", F.size("c").alias("n"), F.try_element_at("c", F.lit(1))["value"].alias("first")), "SELECT match_type, value, CASE WHEN verdict IS NULL THEN 0 ELSE 1 END AS n, CASE WHEN verdict IS NOT NULL THEN lower(value) END AS first FROM sender_rule")
_MISSES = lambda r: r.message.select(F.when(F.col("direction") == "inbound", "explored").otherwise("missed").alias("kind"), F.when(F.col("direction") == "inbound", "domain").otherwise("address").alias("match_type"), F.when(F.col("direction") == "inbound", F.col("sender_domain")).otherwise(F.concat(F.lit("hr@"), "sender_domain")).alias("value"))
add("demoted_rules", lambda r: classify.demotions(_MISSES(r), r.sender_rule)[0].select("match_type", "value", "verdict"), "SELECT match_type, value, 'undecided' AS verdict FROM sender_rule WHERE verdict = 'negative' AND source <> 'human' AND match_type = 'domain' AND value IN (SELECT sender_domain FROM message WHERE direction = 'inbound')")
add("taught_by_misses", lambda r: classify.demotions(_MISSES(r), r.sender_rule)[1], "SELECT 'address' AS match_type, 'hr@' || sender_domain AS value, 'negative' AS verdict FROM message WHERE direction = 'outbound' GROUP BY sender_domain HAVING count(*) >= 3")
_FACES = lambda r: r.message.select("id", "sent_at", F.expr("CASE WHEN classified_by = 'model-x' THEN company_id END").alias("company_id"), F.expr("CASE WHEN classified_by = 'model-x' THEN application_id END").alias("application_id"), F.expr("CASE WHEN length(sender_domain) > 10 THEN thread_id ELSE id END").alias("thread_id"), F.concat_ws(".", "application_id", "sender_domain").alias("message_id_header"), F.concat_ws(".", F.col("application_id") + 1, "sender_domain").alias("in_reply_to"))
add(
    "reply_context", lambda r: up.reply_context(_FACES(r)).select("id", "company_id", "application_id"),
    """, f AS (SELECT id, sent_at, CASE WHEN classified_by = 'model-x' THEN company_id END AS c, CASE WHEN classified_by = 'model-x' THEN application_id END AS a, CASE WHEN length(sender_domain) > 10 THEN thread_id ELSE id END AS t,
  concat(application_id, '.', sender_domain) AS h, concat(application_id + 1, '.', sender_domain) AS p FROM message),
bt AS (SELECT t, arg_max({'c': c, 'a': a}, {'s': sent_at, 'i': id}) AS r FROM f WHERE c IS NOT NULL GROUP BY 1), bh AS (SELECT h, arg_max({'c': c, 'a': a}, {'s': sent_at, 'i': id}) AS r FROM f WHERE c IS NOT NULL GROUP BY 1)
SELECT f.id, coalesce(f.c, bt.r.c, bh.r.c) AS company_id, CASE WHEN f.c IS NOT NULL THEN f.a WHEN bt.r IS NOT NULL THEN bt.r.a ELSE bh.r.a END AS application_id FROM f LEFT JOIN bt ON bt.t = f.t LEFT JOIN bh ON bh.h = f.p""",
)
add(
    "domain_carry_without_bulk", lambda r: ru.domain_carry(r.message.join(r.correspondence.select("id", F.col("bulk").alias("is_bulk")), "id").withColumn("company_id", F.lit(None).cast("long")), r.company.withColumn("domain", F.expr("concat('s', CAST(id AS STRING), '.example')"))),
    "SELECT m.id, c.id AS company_id FROM message m JOIN correspondence USING (id) JOIN company c ON concat('s', c.id, '.example') = m.sender_domain WHERE NOT bulk",
)
# companies
_MERGING = lambda r: r.company.filter("id % 7 = 3").select(F.col("id").alias("old"), (F.col("id") - 1).alias("new"))
_MERGED = lambda r: up.merge_companies(_named(r), r.application, r.message, rs.company_aliases(_named(r)), _MERGING(r))
add("merge_companies_mail", lambda r: _MERGED(r)[2].select("id", "company_id"), "SELECT id, CASE WHEN company_id % 7 = 3 THEN company_id - 1 ELSE company_id END AS company_id FROM message")
_ALI = ", ali AS (SELECT DISTINCT id AS company_id, unnest(list_filter([name, replace(name, ' ', ''), label], lambda x: x IS NOT NULL AND x <> '')) AS alias FROM named)"
add("merge_companies_aliases", lambda r: _MERGED(r)[3], _NAMED + _ALI + " SELECT DISTINCT CASE WHEN company_id % 7 = 3 THEN company_id - 1 ELSE company_id END AS company_id, alias FROM ali")
_RENAMES = lambda r: r.company.filter("id % 4 = 1").select("id", F.concat(F.lit("New Name "), "id").alias("name"), F.expr("CASE WHEN id % 8 = 1 THEN 'agency' END").alias("kind"))
_NONE = lambda r: rs.company_aliases(_named(r)).limit(0)
add("rename_companies", lambda r: up.rename_companies(r.company, _NONE(r), _RENAMES(r))[0], "SELECT id, CASE WHEN id % 4 = 1 THEN concat('New Name ', id) ELSE canonical_name END AS canonical_name, domain, CASE WHEN id % 8 = 1 THEN 'agency' ELSE kind END AS kind FROM company")
add("rename_companies_aliases", lambda r: up.rename_companies(r.company.withColumn("domain", F.lit(None).cast("string")), _NONE(r), _RENAMES(r))[1].filter("alias LIKE 'new%'"), "SELECT id AS company_id, concat('new name ', id) AS alias FROM company WHERE id % 4 = 1 UNION ALL SELECT id, concat('newname', id) FROM company WHERE id % 4 = 1")
_VERDICTS = lambda r: r.company.filter("id % 3 > 0").select(F.col("id").alias("company_id"), (F.col("id") % 3 == 1).alias("negative"), F.expr("CASE WHEN id % 2 = 0 THEN concat('Fixed ', CAST(id AS STRING)) END").alias("name"), F.lit(None).cast("string").alias("kind"), F.array(F.struct(F.lit("domain").alias("match_type"), F.concat(F.lit("s"), F.col("id") % 150, F.lit(".example")).alias("value"), F.lit("negative").alias("verdict"))).alias("rules"))
_VERIFIED = lambda r: up.apply_verifications(r.company, r.application, r.stage_event, r.message, r.sender_rule, _NONE(r), _VERDICTS(r))
add("verified_companies", lambda r: _VERIFIED(r)["companies"], "SELECT id, CASE WHEN id % 3 = 2 AND id % 2 = 0 THEN concat('Fixed ', id) ELSE canonical_name END AS canonical_name, domain, kind FROM company WHERE id % 3 <> 1")
add("verified_rules", lambda r: _VERIFIED(r)["rules"].select("match_type", "value", "verdict", "source"), "SELECT match_type, value, verdict, source FROM sender_rule UNION ALL SELECT 'domain', v, 'negative', 'verification' FROM (SELECT DISTINCT concat('s', id % 150, '.example') AS v FROM company WHERE id % 3 > 0) WHERE v NOT IN (SELECT value FROM sender_rule WHERE match_type = 'domain')")
add("verified_mail", lambda r: _VERIFIED(r)["messages"].select("id", "company_id", "classified_by"), "SELECT id, CASE WHEN company_id % 3 <> 1 THEN company_id END AS company_id, CASE WHEN company_id % 3 <> 1 THEN classified_by ELSE 'rule:negative' END AS classified_by FROM message")
add("verified_events", lambda r: _VERIFIED(r)["events"].select("id", "application_id"), "SELECT id, application_id FROM stage_event WHERE application_id IN (SELECT id FROM application WHERE company_id % 3 <> 1)")
add(
    "verification_list", lambda r: lists.verification_list(r.review_queue.join(r.message.select(F.col("id").alias("message_id"), "company_id"), "message_id").select("id", "company_id", "created_at", (F.col("status") == "approved").alias("classification_correct"))).select("company_id", "id", "classification_correct"),
    "SELECT company_id, id, ok AS classification_correct FROM (SELECT m.company_id, q.id, q.status = 'approved' AS ok, row_number() OVER (PARTITION BY m.company_id ORDER BY q.created_at DESC, q.id DESC) AS k FROM review_queue q JOIN message m ON m.id = q.message_id) WHERE k = 1",
)
# contacts
_FROM = lambda r: r.message.join(r.correspondence.select("id", F.expr("CASE WHEN bulk THEN 'No-Reply@x.example' ELSE a2 END").alias("address")), "id").select("address", "company_id", "sent_at")
_CONTACTS = lambda r: _FROM(r).filter("address LIKE 'p1%'").select(F.md5(F.lower("address").cast("binary")).alias("contact_id"), F.lower("address").alias("identifier")).distinct()
_OLD = lambda r: _CONTACTS(r).select("contact_id", F.lit(1).cast("long").alias("company_id"), F.lit("1990-01-01 00:00:00").cast("timestamp_ntz").alias("first_at"), F.lit("1990-01-02 00:00:00").cast("timestamp_ntz").alias("last_at"))
_TIMES = lambda df: df.withColumn("first_at", F.col("first_at").cast("timestamp_ntz")).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))
add("contacts", lambda r: up.resolve_contacts(_CONTACTS(r), _OLD(r), _FROM(r), "p3@s3.example")[0], "SELECT DISTINCT md5(a2) AS contact_id, a2 AS identifier FROM correspondence WHERE NOT bulk AND (a2 <> 'p3@s3.example')")
add(
    "contact_links", lambda r: _TIMES(up.resolve_contacts(_CONTACTS(r), _OLD(r), _FROM(r), "p3@s3.example")[1]),
    """, f AS (SELECT md5(a2) AS contact_id, company_id, sent_at, a2 FROM message JOIN correspondence USING (id) WHERE NOT bulk),
u AS (SELECT contact_id, company_id, sent_at AS f, sent_at AS l FROM f WHERE a2 <> 'p3@s3.example' UNION ALL SELECT DISTINCT contact_id, 1, TIMESTAMP '1990-01-01', TIMESTAMP '1990-01-02' FROM f WHERE a2 LIKE 'p1%')
SELECT contact_id, company_id, min(f) AS first_at, max(l) AS last_at FROM u GROUP BY 1, 2""",
)
add(
    "contact_details", lambda r: _TIMES(up.contact_details(_FROM(r))),
    """, e AS (SELECT lower(CASE WHEN bulk THEN 'No-Reply@x.example' ELSE a2 END) AS identifier, company_id, count(*) AS n, min(sent_at) AS f, max(sent_at) AS l FROM message JOIN correspondence USING (id) GROUP BY 1, 2)
SELECT identifier, count(*) AS companies, sum(n) AS messages, min(f) AS first_at, max(l) AS last_at, arg_max(company_id, n * 1000000 - company_id) AS busiest FROM e GROUP BY 1""",
)
add("automated_senders", lambda r: r.correspondence.select("id", nz.automated(F.expr("CASE WHEN bulk THEN concat('<No-Reply-', CAST(length(a2) AS STRING), '@x.example>') WHEN label IS NOT NULL THEN 'notifications@x.example' ELSE a2 END")).alias("automated")), "SELECT id, CASE WHEN bulk OR label IS NOT NULL THEN 'no-reply' END AS automated FROM correspondence")
_SENT = lambda r: r.message.join(r.correspondence.select("id", F.col("a2").alias("address")), "id").select("id", "company_id", "address", "sent_at")
add(
    "people_of_companies", lambda r: rs.people_of_companies(_SENT(r), r.stage_event.filter("stage <> 'onsite'"), "P0@s0.example").withColumn("stages", F.array_join("stages", ",")),
    """, f AS (SELECT id, company_id, a2 AS address, sent_at FROM message JOIN correspondence USING (id) WHERE a2 <> 'p0@s0.example'),
n AS (SELECT company_id, address, count(*) AS n, min(sent_at) AS first_at, max(sent_at) AS last_at FROM f GROUP BY 1, 2),
st AS (SELECT company_id, address, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages FROM f JOIN stage_event e ON e.evidence_message_id = f.id WHERE stage <> 'onsite' GROUP BY 1, 2)
SELECT n.*, CAST(NULL AS VARCHAR) AS automated, coalesce(stages, '') AS stages, count(*) OVER (PARTITION BY address) AS companies FROM n LEFT JOIN st USING (company_id, address)""",
)
_TO = lambda r: r.subject.join(r.correspondence.select("id", "a1", "a2"), "id").select("id", nz.reply_recipients(F.expr("CASE WHEN idx % 3 = 0 THEN array('Desk@acme.example', 'desk@acme.example') END"), F.expr("array(CASE direction WHEN 'outbound' THEN 'Me@own.example' ELSE sender END)"), F.expr("array(a1, a2, 'ME@own.example')"), F.expr("array(upper(a2), 'boss@acme.example', lower(a1))"), ["me@OWN.example"]).alias("r"))
add(
    "reply_recipients", lambda r: _TO(r).select("id", F.array_join("r.to", ",").alias("to"), F.array_join("r.cc", ",").alias("cc")),
    """SELECT id, CASE WHEN idx % 3 = 0 THEN 'Desk@acme.example' WHEN s.direction = 'outbound' THEN a1 || ',' || a2 ELSE sender END AS "to",
  CASE WHEN idx % 3 > 0 AND s.direction = 'outbound' THEN '' ELSE a1 || ',' || a2 || ',' END || 'boss@acme.example' AS cc FROM subject s JOIN correspondence USING (id)""",
)
_BODIES = lambda r: r.subject.join(r.message.select("id", "sent_at"), "id").withColumn("body", F.expr("CASE WHEN idx % 3 > 0 THEN concat('We  write about ', subject, '\n in full') END"))
add(
    "chain_digest", lambda r: rp.chain_digest(_BODIES(r)),
    """, l AS (SELECT s.*, m.sent_at, count(*) OVER (PARTITION BY s.application_id) - idx < 4 OR regexp_matches(lower(subject), 'welcome to|offer letter|h-1b|immigration|background check|payroll') AS shown FROM subject s JOIN message m USING (id))
SELECT application_id, string_agg(concat(idx, '. ', strftime(sent_at, '%Y-%m-%d'), CASE WHEN direction = 'outbound' THEN ' -> ' ELSE ' <- ' END, sender, ': ', subject, CASE WHEN shown AND idx % 3 > 0 THEN concat(chr(10), '     | We write about ', subject, ' in full') ELSE '' END), chr(10) ORDER BY idx) AS digest FROM l GROUP BY 1""",
)
# readings and queues
_JUDGED = lambda r: r.message.join(r.correspondence.select("id", F.col("bulk").alias("is_bulk"), F.col("a2").alias("sender_address")), "id")
_TOLD = lambda r: r.application.filter("id % 4 < 2").select(F.concat(F.lit("t"), "id").alias("thread_id"), F.expr("CASE id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'unclassified' END").alias("label"), F.expr("CASE WHEN id % 5 > 0 THEN concat('rel', CAST(id % 5 AS STRING)) END").alias("relationship"), F.expr("concat('kind', CAST(id % 4 AS STRING))").alias("company_kind"), F.expr("concat('since ', CAST(id % 37 AS STRING))").alias("reasoning"))
add(
    "domain_dossiers", lambda r: ru.domain_dossiers(_JUDGED(r), _TOLD(r), r.review_queue.filter("status = 'pending'"), r.sender_rule, "s3.example"),
    """, j AS (SELECT sender_domain AS domain, m.*, bulk, a2 FROM message m JOIN correspondence USING (id) WHERE sender_domain <> 's3.example' AND sender_domain NOT IN (SELECT value FROM sender_rule WHERE match_type = 'domain')),
k AS (SELECT concat('t', id) AS thread_id, id % 3 AS label, CASE WHEN id % 5 > 0 THEN concat('rel', id % 5) END AS relationship, concat('kind', id % 4) AS kind, concat('since ', id % 37) AS reasoning FROM application WHERE id % 4 < 2),
c AS (SELECT domain, count(*) AS messages, count(company_id) AS linked, count(*) FILTER (bulk) AS bulk, count(DISTINCT a2) AS senders FROM j
  WHERE classified_by = 'model-x' OR id IN (SELECT message_id FROM review_queue WHERE status = 'pending') OR thread_id IN (SELECT thread_id FROM k) GROUP BY 1),
t AS (SELECT domain, count(DISTINCT thread_id) FILTER (label = 0) AS negative, count(DISTINCT thread_id) FILTER (label = 1) AS positive, count(DISTINCT thread_id) FILTER (label = 2) AS unclassified,
  coalesce(string_agg(DISTINCT relationship, ', ' ORDER BY relationship), '') AS relationships, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds, left(string_agg(DISTINCT reasoning, ' | ' ORDER BY reasoning), 400) AS reasoning FROM k JOIN j USING (thread_id) GROUP BY 1)
SELECT c.*, coalesce(negative, 0) AS negative, coalesce(positive, 0) AS positive, coalesce(unclassified, 0) AS unclassified, relationships, kinds, reasoning FROM c LEFT JOIN t USING (domain)""",
)
_READ = lambda r: r.application.filter("id % 2 = 0").select(F.concat(F.lit("t"), "id").alias("thread_id"), F.expr("CASE id % 3 WHEN 0 THEN 'positive' ELSE 'negative' END").alias("label"))
add(
    "thread_readings", lambda r: up.thread_readings(_READ(r), r.message).select("thread_id", "label", "id", "direction", "of_label"),
    """, k AS (SELECT concat('t', id) AS thread_id, CASE WHEN id % 3 = 0 THEN 'positive' ELSE 'negative' END AS label FROM application WHERE id % 2 = 0),
n AS (SELECT thread_id, id, direction FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY sent_at DESC, id DESC) AS k FROM message) WHERE k = 1)
SELECT k.thread_id, label, n.id, n.direction, (SELECT count(*) FROM k x WHERE x.label = k.label) AS of_label FROM k LEFT JOIN n USING (thread_id)""",
)
add("triage_counts", lambda r: up.triage_counts(r.review_queue), "SELECT reason, status, count(*) AS n, min(created_at) AS oldest FROM review_queue GROUP BY 1, 2")
add("categories", lambda r: up.categories(r.sender_rule, r.sender_category), "SELECT c.category, c.verdict, c.company_id, count(u.value) AS rules, count(*) FILTER (u.match_type = 'domain') AS domains FROM sender_category c LEFT JOIN sender_rule u USING (category) GROUP BY ALL")
add("close_by_reason", lambda r: up.close_by_reason(r.review_queue, "unclassified", "dismissed").select("id", "status"), "SELECT id, CASE WHEN status = 'pending' AND reason = 'unclassified' THEN 'dismissed' ELSE status END AS status FROM review_queue")
add("verdict_routes", lambda r: classify.route(r.company.select("id", F.expr("CASE id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'ambiguous' ELSE 'positive' END").alias("label"), F.expr("CASE WHEN id % 5 > 0 THEN canonical_name END").alias("company_name"), "domain")  .withColumnRenamed("domain", "company_domain")).select("id", "branch", "reason"),
    "SELECT id, CASE WHEN id % 4 = 0 THEN 'negative' WHEN id % 4 > 1 AND (id % 7 > 0 OR id % 5 > 0) THEN 'record' ELSE 'queue' END AS branch, CASE WHEN id % 4 = 1 THEN 'unclassified' WHEN id % 4 > 1 AND id % 7 = 0 AND id % 5 = 0 THEN 'job-related but no company identified' END AS reason FROM company")
add(
    "accuracies", lambda r: up.accuracies(r.stage_event.join(r.correspondence.select("id", "bulk", F.length("a2").alias("n")), "id").select(F.expr("CASE WHEN n % 5 > 0 THEN stage END").alias("gold_stage"), F.expr("CASE WHEN n % 2 = 0 THEN stage END").alias("stage"), F.col("application_id").alias("gold_company"), (F.col("application_id") + F.col("n") % 3).alias("company"), F.col("bulk").alias("automated"), (F.col("n") % 4 == 0).alias("kept"))),
    """SELECT count(*) FILTER (n % 5 > 0 AND n % 2 = 0) / count(*) FILTER (n % 5 > 0) AS stage_accuracy, count(*) FILTER (n % 3 = 0) / count(*) AS company_accuracy, count(*) FILTER (bulk AND n % 4 <> 0) / count(*) FILTER (bulk) AS automated_recall
FROM (SELECT length(a2) AS n, bulk FROM correspondence)""",
)
# silence and briefings
_OPEN = f"FROM lm LEFT JOIN ls USING (application_id), clock WHERE lm.direction = 'outbound' AND NOT coalesce(stage IN {TERMINAL}, false)"
add("silences", lambda r: _since(up.silences(r)), f"SELECT * FROM (SELECT lm.application_id, 'going_cold' AS state, sent_at + INTERVAL 14 DAY AS since, clock_at {_OPEN} UNION ALL SELECT lm.application_id, 'ghosted', sent_at + INTERVAL 21 DAY, clock_at {_OPEN}) WHERE since < clock_at".replace("SELECT * FROM", "SELECT application_id, state, since FROM"))


def _since(rows):
    return rows.withColumn("since", F.col("since").cast("timestamp_ntz"))


_RANK = "list_position(['applied', 'recruiter_screen', 'phone_screen', 'technical', 'onsite', 'rejected', 'withdrawn', 'offer', 'declined', 'accepted'], stage)"


def stages_of(r):
    from ledgerline.operators.scope import last_message, latest_stage

    return last_message(r).join(latest_stage(r).select("application_id", "stage"), "application_id", "left").join(r.company.select(F.col("id").alias("company_id"), "canonical_name"), "company_id").select("application_id", "canonical_name", "stage", "sent_at")


_ROWS = "FROM lm LEFT JOIN ls USING (application_id) JOIN company c ON c.id = lm.company_id"
for _by, _order in (("stage", f"coalesce({_RANK}, 0) DESC"), ("company", "lower(canonical_name)"), ("silence", "sent_at"), ("touch", "sent_at DESC")):
    add(f"briefing_by_{_by}", lambda r, by=_by: up.briefing_order(stages_of(r), by).select("application_id", F.col("position").cast("long").alias("position")), f"SELECT lm.application_id, row_number() OVER (ORDER BY {_order}, lm.application_id) AS position {_ROWS}")


# archive and runs


def _archive(spark, sf_dir):
    return env.write_once(None, env.with_keys(_mail(spark, sf_dir)))


def imported(spark, sf_dir):
    archive = _archive(spark, sf_dir)
    return env.import_archive(archive, archive.filter("external_id LIKE '%.0'")).select("message_id_header", "is_broken")


QUERIES["import_archive"] = imported
ORACLES["import_archive"] = "SELECT concat('<', conv_id, '.', turn, '@mail.example>') AS message_id_header, false AS is_broken FROM conversations WHERE turn <> 0"
QUERIES["rebuild_people"] = lambda spark, sf_dir: env.rebuild(_archive(spark, sf_dir))["people"].select("sender_address", "n", F.date_format("first_at", "HH:mm:ss").alias("first_at"), F.date_format("last_at", "HH:mm:ss").alias("last_at"))
_ADDRESS = "CASE WHEN role = 'user' THEN 'me@own.example' ELSE concat('a', conv_id % 9, '@firm.example') END"
_SECOND = "concat('10:00:', lpad(CAST(turn % 60 AS VARCHAR), 2, '0'))"
ORACLES["rebuild_people"] = f"SELECT {_ADDRESS} AS sender_address, count(*) AS n, min({_SECOND}) AS first_at, max({_SECOND}) AS last_at FROM conversations GROUP BY 1"
QUERIES["rebuild_threads"] = lambda spark, sf_dir: env.rebuild(_archive(spark, sf_dir))["threads"].select("subject", "n", "sent")
ORACLES["rebuild_threads"] = "SELECT concat('Topic ', conv_id) AS subject, count(*) AS n, count(*) FILTER (role = 'user') AS sent FROM conversations GROUP BY 1"


def rebuilt_twice(spark, sf_dir):
    one, two = (env.rebuild(_archive(spark, sf_dir)) for _ in range(2))
    out = None
    for name in sorted(one):
        row = one[name].agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")).crossJoin(quality.difference(one[name], two[name]).agg(F.count(F.lit(1)).alias("differing")))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES["rebuild_equality"] = rebuilt_twice
ORACLES["rebuild_equality"] = f"SELECT 'messages' AS \"table\", count(*) AS rows, 0 AS differing FROM conversations UNION ALL SELECT 'people', count(DISTINCT {_ADDRESS}), 0 FROM conversations UNION ALL SELECT 'threads', count(DISTINCT conv_id), 0 FROM conversations"


def filled(spark, sf_dir):
    parsed = env.parse_messages(_archive(spark, sf_dir))
    holes = parsed.withColumn("subject", F.when(F.col("is_bulk"), F.lit("kept"))).withColumn("sender_address", F.lit(None).cast("string"))
    return env.backfill(holes, parsed, ["subject", "sender_address"]).select("message_id_header", "subject", "sender_address")


QUERIES["envelope_backfill"] = filled
ORACLES["envelope_backfill"] = f"SELECT concat('<', conv_id, '.', turn, '@mail.example>') AS message_id_header, CASE WHEN turn % 4 = 0 THEN 'kept' ELSE concat('Topic ', conv_id) END AS subject, {_ADDRESS} AS sender_address FROM conversations"


def _listing(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("channel"), (F.col("user_id") % 7).alias("account"), F.col("event_id").alias("external_id"), F.col("ts").alias("occurred_at"), "value")


def one_day(spark, sf_dir):
    rows = _listing(spark, sf_dir)
    day = str(rows.agg(F.to_date(F.max("occurred_at"))).first()[0])
    return env.fresh_for_day(rows, rows.filter("external_id % 3 = 0"), day).select("channel", "account", "external_id")


QUERIES["ingest_day"] = one_day
ORACLES["ingest_day"] = "SELECT event_type AS channel, user_id % 7 AS account, event_id AS external_id FROM events WHERE event_id % 3 <> 0 AND ts >= (SELECT max(ts)::DATE FROM events)"


def days(spark, sf_dir, build):
    runs = _runs(spark, sf_dir).filter("id < 2 AND dayofyear(day) % 5 > 0")
    since, until = runs.agg(F.min("day"), F.max("day")).first()
    return build(spark, str(since), str(until), runs)


_DAYS = f"WITH {_RUNS}, u AS (SELECT * FROM runs WHERE id < 2 AND dayofyear(day) % 5 > 0), d AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM u)::TIMESTAMP, (SELECT max(day) FROM u)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day)"
QUERIES["backfill_days"] = lambda spark, sf_dir: days(spark, sf_dir, env.backfill_days)
ORACLES["backfill_days"] = f"{_DAYS} SELECT d.day, CASE WHEN count(u.day) = 0 THEN 'open' WHEN bool_and(u.failed) THEN 'failed' ELSE 'done' END AS status FROM d LEFT JOIN u USING (day) GROUP BY 1"
QUERIES["days_to_run"] = lambda spark, sf_dir: days(spark, sf_dir, env.days_to_run)
ORACLES["days_to_run"] = f"{_DAYS} SELECT day FROM d WHERE day NOT IN (SELECT day FROM u WHERE NOT failed)"


def cursors(spark, sf_dir):
    rows = _listing(spark, sf_dir).select(F.col("channel").alias("source"), "account", F.col("occurred_at").cast("timestamp_ntz").alias("sent_at"), (F.col("value") > 99.9).alias("failed"), "external_id")
    return up.advance_cursors(rows.filter("external_id % 10 = 0 AND account < 6").groupBy("source", "account").agg(F.max("sent_at").alias("mark")), rows.filter("account > 0"))


QUERIES["advance_cursors"] = cursors
ORACLES["advance_cursors"] = """WITH e AS (SELECT event_type AS source, user_id % 7 AS account, ts::TIMESTAMP AS ts, value > 99.9 AS failed, event_id FROM events),
c AS (SELECT source, account, max(ts) AS mark FROM e WHERE event_id % 10 = 0 AND account < 6 GROUP BY 1, 2), b AS (SELECT source, account, max(ts) AS top, bool_or(failed) AS bad FROM e WHERE account > 0 GROUP BY 1, 2)
SELECT coalesce(c.source, b.source) AS source, coalesce(c.account, b.account) AS account, CASE WHEN NOT bad AND (mark IS NULL OR top > mark) THEN top ELSE mark END AS mark FROM c FULL JOIN b ON b.source = c.source AND b.account = c.account"""


def ad_hoc(spark, sf_dir):
    record(spark, sf_dir).company.createOrReplaceTempView("company")
    return env.read_only(spark, "SELECT kind, count(*) AS n, count(domain) AS with_domain FROM company GROUP BY kind")


QUERIES["ad_hoc_sql"] = ad_hoc
ORACLES["ad_hoc_sql"] = over_record("SELECT kind, count(*) AS n, count(domain) AS with_domain FROM company GROUP BY kind")


def unembedded(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 3 > 0").select(F.col("vec_id").alias("doc_id"))
    return docs.join(held, "doc_id", "left_anti").select("doc_id", F.md5(search.embedding_text(F.col("text"), F.col("source")).cast("binary")).alias("digest"))


QUERIES["unembedded"] = unembedded
ORACLES["unembedded"] = "SELECT doc_id, md5(coalesce(nullif(trim(text), ''), nullif(trim(source), ''), '(empty)')) AS digest FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 > 0)"
