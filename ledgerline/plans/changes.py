"""Queries of changes to the whole record: verification, distillation, audits that are applied, teaching in batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import expand
from ledgerline.operators import reports as rp
from ledgerline.operators import upkeep as up
from ledgerline.storage import stage

from .adapters import record
from .sql import over_record

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, build, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(record(spark, sf_dir))
    ORACLES[name] = over_record(sql)


# verification: two companies of three are judged, one of them negatively; the own mailbox is at one of the suggested domains
def _verdicts(r):
    rule = lambda kind, value: F.struct(F.lit(kind).alias("match_type"), value.alias("value"), F.lit("negative").alias("verdict"))
    rules = F.array(rule("domain", F.concat(F.lit("s"), F.col("id") % 150, F.lit(".example"))), rule("address", F.lit("Me@S6.example")), rule("domain", F.lit("S6.Example ")))
    name = F.expr("CASE WHEN id % 2 = 0 THEN concat('Fixed ', CAST(id AS STRING)) END")
    return r.company.filter("id % 3 > 0").select(F.col("id").alias("company_id"), (F.col("id") % 3 == 1).alias("negative"), name.alias("name"), F.lit(None).cast("string").alias("kind"), rules.alias("rules"))


def _links(r):
    return r.message.filter("classified_by IS NULL").select(F.col("id").alias("message_id"), (F.col("company_id") + 1).alias("company_id"))


def _aliases(r):
    return r.company.select(F.col("id").alias("company_id"), F.concat(F.lit("old"), "id").alias("alias"))


def _verified(r):
    known = r.sender_rule.filter("match_type = 'address' OR value <> 's6.example'")
    return up.apply_verifications(r.company, r.application, r.stage_event, r.message, known, _aliases(r), _verdicts(r), "me@s6.example", _links(r), "model-y")


_KNOWN = "(SELECT * FROM sender_rule WHERE match_type = 'address' OR value <> 's6.example')"
add(
    "verified_own_mailbox", lambda r: _verified(r)["rules"].select("match_type", "value", "verdict", "source"),
    f"""SELECT match_type, value, verdict, source FROM {_KNOWN} UNION ALL SELECT 'domain', v, 'negative', 'verification' FROM (SELECT DISTINCT concat('s', id % 150, '.example') AS v FROM company WHERE id % 3 > 0)
WHERE v <> 's6.example' AND v NOT IN (SELECT value FROM {_KNOWN} WHERE match_type = 'domain')""",
)
add("verified_links", lambda r: _verified(r)["links"], "SELECT id AS message_id, company_id + 1 AS company_id FROM message WHERE classified_by IS NULL AND company_id % 3 <> 1 AND (company_id + 1) % 3 <> 1")
add(
    "verification_audit", lambda r: _verified(r)["verifications"].select("company_id", "model", "correct", "verified_name", F.size("suggested").alias("suggested")),
    "SELECT id AS company_id, 'model-y' AS model, id % 3 <> 1 AS correct, CASE WHEN id % 2 = 0 THEN concat('Fixed ', id) END AS verified_name, 3 AS suggested FROM company WHERE id % 3 > 0",
)
# distillation: services that all use, the own domain, and domains with positive readings
_SERVED = "CASE WHEN sender_domain LIKE '%7.example' THEN 'calendly.com' WHEN sender_domain LIKE '%3.example' THEN 'own.example' ELSE sender_domain END"


def _distilled(r):
    domains = r.message.groupBy(F.expr(_SERVED).alias("sender_domain")).agg(F.lit(0).alias("linked")).withColumn("positive", F.when(F.col("sender_domain").like("%2.example"), 3).otherwise(0))
    readings = domains.select(F.upper("sender_domain").alias("domain"), F.when(F.col("sender_domain").like("%1.example"), "undecided").otherwise("negative").alias("verdict"))
    return up.distilled(readings, domains, r.sender_rule.filter("source = 'human'"), "me@own.example")


add(
    "distilled_with_vetoes", lambda r: _distilled(r).select("match_type", "value", "verdict", "source"),
    f"""SELECT match_type, value, verdict, source FROM sender_rule WHERE source = 'human' UNION ALL SELECT 'domain', d, CASE WHEN d LIKE '%1.example' THEN 'undecided' ELSE 'negative' END, 'distilled' FROM (SELECT DISTINCT {_SERVED} AS d FROM message)
WHERE d NOT IN ('calendly.com', 'own.example') AND d NOT LIKE '%2.example' AND d NOT IN (SELECT value FROM sender_rule WHERE match_type = 'domain' AND source = 'human')""",
)
# audit of companies: chains of merges, merges into what is deleted, deletions that give way, renames
_PLAN = """SELECT id, 'delete' AS action, CAST(NULL AS BIGINT) AS target, CAST(NULL AS STRING) AS name FROM {c} WHERE id % 7 = 0 OR id % 7 = 5 UNION ALL
SELECT id, 'merge', CASE id % 7 WHEN 1 THEN id - 7 WHEN 2 THEN id - 2 WHEN 4 THEN id ELSE id - 1 END, NULL FROM {c} WHERE id % 7 IN (2, 4, 5) OR (id % 7 = 1 AND CAST(floor(id / 7) AS BIGINT) % 4 <> 0) UNION ALL
SELECT id, 'rename', NULL, concat('New Name ', CAST(id AS STRING)) FROM {c} WHERE id % 7 = 3"""


def _audited(r):
    plan = r.company.sparkSession.sql(_PLAN, c=r.company)
    tables = {"companies": r.company, "applications": r.application, "events": r.stage_event, "messages": r.message, "aliases": _aliases(r), "links": _links(r), "rules": r.sender_rule}
    return up.apply_company_audit(tables, plan)


_TO = "CASE WHEN {0} % 7 = 1 THEN {0} - 7 * (({0} // 7) % 4) WHEN {0} % 7 = 5 THEN {0} - 1 ELSE {0} END"
_STAYS = "NOT (id % 7 IN (0, 5)) AND NOT (id % 7 = 1 AND (id // 7) % 4 <> 0)"
add("audited_companies", lambda r: _audited(r)["companies"].select("id", "canonical_name"), f"SELECT id, CASE WHEN id % 7 = 3 THEN concat('New Name ', id) ELSE canonical_name END AS canonical_name FROM company WHERE {_STAYS}")
add("audited_applications", lambda r: _audited(r)["applications"].select("id", "company_id"), f"SELECT id, {_TO.format('company_id')} AS company_id FROM application WHERE company_id % 7 <> 0")
add("audited_events", lambda r: _audited(r)["events"].select("id", "application_id"), "SELECT e.id, application_id FROM stage_event e JOIN application a ON a.id = application_id WHERE a.company_id % 7 <> 0")
add("audited_mail", lambda r: _audited(r)["messages"].select("id", "company_id", "application_id", "classified_by"), f"SELECT id, CASE WHEN company_id % 7 <> 0 THEN {_TO.format('company_id')} END AS company_id, CASE WHEN company_id % 7 <> 0 THEN application_id END AS application_id, CASE WHEN company_id % 7 <> 0 THEN classified_by END AS classified_by FROM message")
add("audited_aliases", lambda r: _audited(r)["aliases"].filter("alias LIKE 'old%'"), f"SELECT {_TO.format('id')} AS company_id, concat('old', id) AS alias FROM company WHERE id % 7 <> 0")
add("audited_links", lambda r: _audited(r)["links"],  # a link to a company that isn't there is neither merged nor deleted
    f"SELECT DISTINCT m.id AS message_id, CASE WHEN c.id IS NULL THEN company_id + 1 ELSE {_TO.format('(company_id + 1)')} END AS company_id FROM message m LEFT JOIN company c ON c.id = company_id + 1 WHERE classified_by IS NULL AND (c.id IS NULL OR (company_id + 1) % 7 <> 0)")
add("audited_rules", lambda r: _audited(r)["rules"].select("match_type", "value", "company_id"), f"SELECT match_type, value, CASE WHEN company_id % 7 <> 0 THEN {_TO.format('company_id')} END AS company_id FROM sender_rule")


# audit of applications: each merges into the one before it, in threes; the first of every other three is deleted, so that nothing merges there
def _application_plan(r):
    own = Window.partitionBy("company_id").orderBy("id")
    rows = r.application.select("id", F.row_number().over(own).alias("n"), F.lag("id").over(own).alias("before"))
    merged = rows.filter("n % 3 <> 1").select("id", F.lit("merge").alias("action"), F.col("before").alias("target"))
    return merged.unionByName(rows.filter("n % 6 = 4").select("id", F.lit("delete").alias("action"), F.lit(None).cast("long").alias("target")))


def _audited_applications(r):
    return up.apply_application_audit(r.application, r.stage_event, r.message, _application_plan(r))


_NTH = ", nth AS (SELECT id, company_id, row_number() OVER (PARTITION BY company_id ORDER BY id) AS n, first_value(id) OVER (PARTITION BY company_id, g ORDER BY id) AS head FROM (SELECT *, (row_number() OVER (PARTITION BY company_id ORDER BY id) - 1) // 3 AS g FROM application))"
add("applications_after_audit", lambda r: _audited_applications(r)[0].select("id", "company_id"), _NTH + " SELECT id, company_id FROM nth WHERE (n - 1) // 3 % 2 = 1 AND n % 6 <> 4 OR (n - 1) // 3 % 2 = 0 AND n % 3 = 1")
add("mail_after_application_audit", lambda r: _audited_applications(r)[2].select("id", "application_id"), _NTH + " SELECT m.id, CASE WHEN n % 6 = 4 THEN NULL WHEN (n - 1) // 3 % 2 = 0 THEN head ELSE application_id END AS application_id FROM message m JOIN nth ON nth.id = application_id")


# teaching: names follow domains, so that what a teaching finds can be told from the first of its name
def _taught(r):
    spark = r.company.sparkSession
    taught = spark.sql("""SELECT CAST(id AS STRING) AS id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * id AS at, 'domain' AS match_type, concat('t', CAST(id % 300 AS STRING), '.example') AS value,
  CASE WHEN id % 4 = 0 THEN 'negative' ELSE 'positive' END AS verdict, concat('Firm ', CAST(id % 300 % 40 AS STRING)) AS company, CAST(NULL AS STRING) AS company_domain,
  CASE WHEN id % 11 = 0 THEN concat('cat', CAST(id % 300 AS STRING)) END AS category, CAST(NULL AS STRING) AS kind FROM {c}""", c=r.company)
    there = r.company.filter("id < 50").select(F.col("id").cast("string").alias("id"), "canonical_name", F.concat(F.lit("t"), F.col("id") * 3, F.lit(".example")).alias("domain"), "kind")
    known = r.sender_rule.withColumn("company_id", F.col("company_id").cast("string"))
    cats = r.sender_category.withColumn("company_id", F.col("company_id").cast("string"))
    mail = r.message.select("id", F.array(F.concat(F.lit("x@t"), F.col("company_id") % 300, F.lit(".example"))).alias("addresses"), F.lit(None).cast("string").alias("company_id"), F.expr("CASE WHEN classified_by = 'model-x' THEN classified_by END").alias("classified_by"))
    return up.teach_batch(taught, there, there.select(F.col("id").alias("company_id"), F.lower("canonical_name").alias("alias")), known, cats, mail)


_TEACHES = """, t AS (SELECT id, CAST(id AS VARCHAR) AS name, id % 300 AS d, id % 300 % 40 AS f, id % 4 = 0 AS no, CASE WHEN id % 11 = 0 THEN concat('cat', id % 300) END AS category FROM company),
there AS (SELECT CAST(id AS VARCHAR) AS c, id * 3 AS d FROM company WHERE id < 50),
fresh AS (SELECT f, arg_min(name, id) AS first FROM t WHERE NOT no AND d NOT IN (SELECT d FROM there) GROUP BY 1),
r AS (SELECT t.*, CASE WHEN NOT no THEN coalesce(c, 'new-' || first) END AS company_id, CASE WHEN no THEN 'negative' ELSE 'positive' END AS verdict FROM t LEFT JOIN there USING (d) LEFT JOIN fresh USING (f)),
last AS (SELECT d, arg_max({'v': verdict, 'c': company_id, 'k': category}, id) AS w FROM r GROUP BY 1),
cat AS (SELECT category, arg_max({'v': verdict, 'c': company_id}, id) AS w FROM r WHERE category IS NOT NULL GROUP BY 1)"""
add("teach_batch_rules", lambda r: _taught(r)["rules"].filter("source = 'human' AND value LIKE 't%'").select("value", "verdict", "category", "company_id"),
    _TEACHES + " SELECT concat('t', d, '.example') AS value, CASE WHEN w.k IS NULL THEN w.v END AS verdict, w.k AS category, CASE WHEN w.k IS NULL THEN w.c END AS company_id FROM last")
add("teach_batch_companies", lambda r: _taught(r)["companies"].filter("id LIKE 'new-%'").select("id", "canonical_name", "domain"),
    _TEACHES + " SELECT concat('new-', first) AS id, concat('Firm ', f) AS canonical_name, concat('t', CAST(first AS BIGINT) % 300, '.example') AS domain FROM fresh")
add("teach_batch_categories", lambda r: _taught(r)["categories"].select("category", "verdict", "company_id"),
    _TEACHES + " SELECT category, verdict, CAST(company_id AS VARCHAR) AS company_id FROM sender_category WHERE category NOT IN (SELECT category FROM cat) UNION ALL SELECT category, w.v, w.c FROM cat")
add("teach_batch_mail", lambda r: _taught(r)["messages"].select("id", "company_id", "classified_by"),
    _TEACHES + """, eff AS (SELECT d, CASE WHEN k IS NULL THEN l.w.v ELSE cat.w.v END AS v, CASE WHEN k IS NULL THEN l.w.c ELSE cat.w.c END AS c FROM (SELECT d, w, w.k AS k FROM last) l LEFT JOIN cat ON cat.category = l.k)
SELECT m.id, CASE WHEN classified_by IS DISTINCT FROM 'model-x' AND v = 'positive' THEN c END AS company_id,
  CASE WHEN classified_by = 'model-x' THEN 'model-x' WHEN v = 'positive' THEN 'rule:learned' WHEN v = 'negative' THEN 'rule:negative' END AS classified_by FROM message m LEFT JOIN eff ON d = m.company_id % 300""")  # fmt: skip


# expansion over domains, addresses and threads, with one residual pass
def _retrieval(r):
    mail = r.message.join(r.correspondence.select("id", "a1", "a2", "label"), "id")
    own = F.lit("Me@own.example")
    people = F.when(F.col("direction") == "outbound", F.array(own, "a1")).when(F.col("application_id") % 40 == 0, F.array("a1", own)).otherwise(F.array("a1", F.lit("list@lists.example")))
    return mail.select("id", "thread_id", "direction", people.alias("addresses"), F.array_compact(F.array("label")).alias("labels"), (F.col("application_id") % 97 == 3).alias("matters"), "application_id")


def _expanded(r):
    mail = stage(_retrieval(r))
    return expand.expand_record(mail, mail.filter("application_id % 97 = 3 AND application_id % 5 = 3 AND direction = 'outbound'"), "me@own.example")


_HOP = """, k{h} AS MATERIALIZED (SELECT DISTINCT key FROM offers WHERE id IN (SELECT id FROM h{p}){used}),
h{h} AS MATERIALIZED (SELECT id, min(CASE WHEN key LIKE 'd:%' THEN 0 WHEN key LIKE 'a:%' THEN 1 ELSE 2 END) AS k FROM meets WHERE key IN (SELECT key FROM k{h}){seen} GROUP BY 1)"""
_HOPS = "".join(_HOP.format(h=h, p=h - 1, used="".join(f" AND key NOT IN (SELECT key FROM k{g})" for g in range(1, h)), seen="".join(f" AND id NOT IN (SELECT id FROM h{g})" for g in range(h))) for h in range(1, 5))
add(
    "expand_record", _expanded,
    f""", x AS (SELECT m.id, thread_id, direction, application_id AS app, lower(a1) AS a1, label, direction <> 'outbound' AND application_id % 40 = 0 AS mine, direction <> 'outbound' AND application_id % 40 <> 0 AS listed FROM message m JOIN correspondence USING (id)),
p AS (SELECT id, app, a1 AS address, split_part(a1, '@', 2) AS domain FROM x UNION ALL SELECT id, app, 'list@lists.example', 'lists.example' FROM x WHERE listed),
th AS (SELECT id, app, 't:' || thread_id AS key FROM x WHERE thread_id IN (SELECT thread_id FROM x WHERE direction = 'outbound')),
offers AS MATERIALIZED (SELECT DISTINCT id, key FROM (SELECT id, app, 'd:' || domain AS key FROM p UNION ALL SELECT id, app, 'a:' || address FROM p UNION ALL SELECT id, app, key FROM th) WHERE app % 97 = 3),
meets AS MATERIALIZED (SELECT DISTINCT id, key FROM (SELECT id, 'd:' || domain AS key FROM p UNION ALL SELECT id, 'd:' || replace(domain, 'mail.', '') FROM p UNION ALL SELECT id, 'a:' || address FROM p UNION ALL SELECT id, key FROM th)),
h0 AS MATERIALIZED (SELECT DISTINCT id FROM x WHERE app % 97 = 3 AND app % 5 = 3 AND direction = 'outbound'){_HOPS},
seen AS MATERIALIZED (SELECT id, 0 AS hop, 'seed' AS via FROM h0 {"".join(f" UNION ALL SELECT id, {h}, ['domain', 'address', 'thread'][k + 1] FROM h{h}" for h in range(1, 5))})
SELECT id, hop, via FROM seen UNION ALL SELECT id, (SELECT coalesce(max(hop), 0) FROM seen) + 1, 'residual' FROM x WHERE mine AND label IS NULL AND id NOT IN (SELECT id FROM seen)""",
)


# what a thread carries beside company and application
def _people_mail(r):
    mail = r.message.select("id", F.expr("CASE WHEN application_id % 2 = 0 THEN concat('c', CAST(company_id AS STRING)) ELSE thread_id END").alias("thread_id"), "sent_at", F.expr("CASE WHEN classified_by = 'model-x' THEN company_id END").alias("company_id"),
                            F.expr("CASE WHEN classified_by = 'model-x' THEN application_id END").alias("application_id"), F.expr("CASE WHEN classified_by = 'model-x' AND application_id % 3 = 0 THEN concat('p', CAST(application_id AS STRING)) END").alias("contact_id"))
    links = mail.filter("company_id % 5 = 0").select(F.col("id").alias("message_id"), (F.col("company_id") + 1).alias("company_id"), F.expr("CASE WHEN application_id % 4 = 0 THEN 'other' ELSE 'agency' END").alias("role"))
    return up.carry_people(mail, links)


_PEOPLE = """, f AS (SELECT id, CASE WHEN application_id % 2 = 0 THEN concat('c', company_id) ELSE thread_id END AS t, sent_at, CASE WHEN classified_by = 'model-x' THEN company_id END AS c, CASE WHEN classified_by = 'model-x' THEN application_id END AS a,
  CASE WHEN classified_by = 'model-x' AND application_id % 3 = 0 THEN concat('p', application_id) END AS p FROM message),
l AS (SELECT id, c + 1 AS agency, CASE WHEN a % 4 = 0 THEN 'other' ELSE 'agency' END AS role FROM f WHERE c % 5 = 0),
top AS (SELECT t, arg_max({'i': id, 'c': c, 'a': a, 'p': p}, {'s': sent_at, 'i': id}) AS r FROM f WHERE c IS NOT NULL GROUP BY 1)"""
add("carry_people", lambda r: _people_mail(r)[0].select("id", "company_id", "application_id", "contact_id"), _PEOPLE + " SELECT id, coalesce(c, r.c) AS company_id, CASE WHEN c IS NULL THEN r.a ELSE a END AS application_id, CASE WHEN c IS NULL THEN r.p ELSE p END AS contact_id FROM f LEFT JOIN top USING (t)")
add("carry_agencies", lambda r: _people_mail(r)[1], _PEOPLE + " SELECT id AS message_id, agency AS company_id, role FROM l UNION SELECT f.id, l.agency, 'agency' FROM f JOIN top USING (t) JOIN l ON l.id = top.r.i WHERE f.c IS NULL AND l.role = 'agency'")
# rules from triage and from audits
_BY = lambda r: r.correspondence.select("id", F.col("a2").alias("sender_address"), "bulk", "known_contact")
add(
    "triage_negatives", lambda r: up.triage_negatives(_BY(r).filter("bulk"), r.sender_rule, "p3@s3.example").select("match_type", "value", "verdict", "source"),
    """SELECT match_type, value, verdict, source FROM sender_rule UNION ALL SELECT 'address', a, 'negative', 'auto' FROM (SELECT DISTINCT a2 AS a, split_part(a2, '@', 2) AS d FROM correspondence WHERE bulk AND a2 <> 'p3@s3.example')
WHERE NOT EXISTS (SELECT 1 FROM sender_rule u WHERE (u.match_type = 'domain' AND u.value = d) OR (u.match_type = 'address' AND u.value = a))""",
)
_AUTO = lambda r: r.sender_rule.withColumn("source", F.when(F.col("source") == "llm", "auto").otherwise(F.col("source"))).withColumn("verdict", F.when(F.col("source") == "auto", "positive").otherwise(F.col("verdict")))
add(
    "rules_after_misses", lambda r: up.teach_from_misses(_BY(r).filter("known_contact AND bulk"), _AUTO(r)).select("match_type", "value", "verdict", "source"),
    """, miss AS (SELECT a2 AS a, split_part(a2, '@', 2) AS d FROM correspondence WHERE known_contact AND bulk), auto AS (SELECT match_type, value, CASE WHEN source = 'llm' THEN 'positive' ELSE verdict END AS verdict, CASE WHEN source = 'llm' THEN 'auto' ELSE source END AS source FROM sender_rule)
SELECT match_type, value, CASE WHEN match_type = 'domain' AND verdict = 'positive' AND source = 'auto' AND value IN (SELECT d FROM miss) THEN 'undecided' ELSE verdict END AS verdict, source FROM auto
UNION ALL SELECT 'address', a, 'negative', 'audit' FROM miss WHERE a NOT IN (SELECT value FROM auto WHERE match_type = 'address') GROUP BY a HAVING count(*) >= 3""",
)
add(
    "timeline_entries", lambda r: rp.timeline_entries(r, r.message.select("company_id", F.concat(F.lit("hr@"), "sender_domain").alias("identifier"))).select("company_id", "kind", "application_id", "at", "name", "evidence"),
    """SELECT company_id, 'application' AS kind, id AS application_id, CAST(started_at AS TIMESTAMP) AS at, coalesce(outcome, role_title) AS name, NULL AS evidence FROM application
UNION ALL SELECT company_id, 'claim', application_id, occurred_at, stage, evidence_message_id FROM cur UNION ALL SELECT DISTINCT company_id, 'person', NULL, NULL, 'hr@' || sender_domain, NULL FROM message""",
)
