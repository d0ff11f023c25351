"""Queries of resolution, mutation, search and quality with their oracle SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ledgerline.operators import lists, mutate, quality, search
from ledgerline.operators import resolve as rs
from ledgerline.schemas import TERMINAL as TERMINAL_STAGES
from ledgerline.storage import shared_dir

from .adapters import record
from .process import _NORM
from .sql import over_record

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, build, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(record(spark, sf_dir))
    if sql:
        ORACLES[name] = over_record(sql)


def add_table(name: str, table: str, build, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    if sql:
        ORACLES[name] = sql


# names that resemble each other, over all companies
_NAMES = "CASE id % 3 WHEN 0 THEN concat('Acme Robotics ', CAST(id % 200 AS STRING)) WHEN 1 THEN concat('Co', CAST(id % 300 AS STRING), ' Inc') ELSE concat('Blue ', CAST(id % 50 AS STRING), ' Systems Ltd') END"


def _named(r):
    return r.company.select("id", F.expr(_NAMES).alias("canonical_name"), "domain", "kind")


_NAMED = f", named AS (SELECT id, {_NORM.format(_NAMES)} AS name, domain, string_split(domain, '.')[1] AS label FROM company), words AS (SELECT *, list_distinct(list_filter(string_split(name, ' '), lambda w: w <> '')) AS w, replace(name, ' ', '') AS sq FROM named)"
_LABELLED = "coalesce({1}.name <> '' AND ({0}.label = {1}.sq OR contains({1}.name, {0}.label) OR contains({0}.label, {1}.name)), false)"
add(
    "merge_candidates", lambda r: rs.candidate_pairs(rs.merge_candidates(_named(r)), None),
    _NAMED + f""" SELECT * FROM (SELECT l.id AS left_id, r.id AS right_id,
  CASE WHEN l.name <> '' AND l.name = r.name THEN 'same name' WHEN s >= 1 THEN 'one name within the other' WHEN s >= 0.6 THEN 'names overlap' WHEN {_LABELLED.format('l', 'r')} OR {_LABELLED.format('r', 'l')} THEN 'name is the other''s domain' END AS reason,
  CAST(CASE WHEN l.name <> '' AND l.name = r.name THEN 1.0 WHEN s >= 1 THEN 0.9 WHEN s >= 0.6 THEN 0.6 WHEN {_LABELLED.format('l', 'r')} OR {_LABELLED.format('r', 'l')} THEN 0.8 END AS DOUBLE) AS score
FROM words l JOIN words r ON l.id < r.id, LATERAL (SELECT len(list_intersect(l.w, r.w)) / nullif(least(len(l.w), len(r.w)), 0) AS s) WHERE coalesce(l.domain = r.domain, true)) WHERE score IS NOT NULL""",
)
add(
    "lookup_companies",
    lambda r: rs.lookup_companies(r.message.select("id", F.expr("concat('Acme Robotics ', CAST(application_id % 260 AS STRING), ', Inc.')").alias("name"), F.expr("CASE WHEN application_id % 3 = 0 THEN concat('co', CAST(application_id % 2000 AS STRING), '.example') WHEN application_id % 3 = 1 THEN 'gmail.com' END").alias("domain")), r.company, rs.company_aliases(_named(r))),
    _NAMED + """, ali AS (SELECT DISTINCT id AS company_id, unnest(list_filter([name, replace(name, ' ', ''), label], lambda x: x IS NOT NULL AND x <> '')) AS alias FROM named),
one AS (SELECT alias, min(company_id) AS c FROM ali GROUP BY 1)
SELECT m.id, coalesce(c.id, a.c, s.c, d.c) AS company_id FROM (SELECT id, concat('acme robotics ', CAST(application_id % 260 AS STRING)) AS n, CASE WHEN application_id % 3 = 0 THEN concat('co', CAST(application_id % 2000 AS STRING), '.example') END AS domain FROM message) m
LEFT JOIN (SELECT domain, min(id) AS id FROM company GROUP BY 1) c ON c.domain = m.domain LEFT JOIN one a ON a.alias = m.n LEFT JOIN one s ON s.alias = replace(m.n, ' ', '') LEFT JOIN one d ON d.alias = string_split(m.domain, '.')[1]""",
)
add("create_companies", lambda r: rs.create_companies(r.message.filter("classified_by = 'model-x'").select("id", F.expr("concat('Acme ', CAST(application_id % 97 AS STRING))").alias("name"), F.expr("CASE WHEN application_id % 5 = 0 THEN concat('acme', CAST(application_id % 97 AS STRING), '.example') END").alias("domain"), F.col("sent_at").alias("at"))), None)
add("assign_applications", lambda r: rs.assign_applications(r.message.join(r.application.select(F.col("id").alias("application_id"), F.col("role_title").alias("role")), "application_id").select("id", "company_id", "role", F.col("sent_at").alias("at"), (F.col("direction") == "outbound").alias("ends"))), None)


def _compatible(r):
    """Members of a class have its name, and a pair of classes of which one has no domains holds whatever the other's are: the representatives decide."""
    found, named = rs.merge_candidates(_named(r)), _named(r)
    side = lambda s: named.select(F.col("id").alias(f"{s}_id"), F.col("canonical_name").alias(f"{s}_name"), F.col("domain").alias(f"{s}_domain"))
    return rs.compatible(found.join(side("left"), "left_id").join(side("right"), "right_id")).select("left_id", "right_id", "left_whole", "right_whole", "reason", "ok")


add("compatible_merges", _compatible, None)
add(
    "known_contacts", lambda r: rs.known_contacts(r.correspondence.select("id", F.lit("mail").alias("channel"), F.array("a1", "a2").alias("addresses")), r.sender_rule.select(F.lit("mail").alias("channel"), F.concat(F.lit("HR@"), F.regexp_replace("value", "^hr@", "")).alias("identifier")), "me@x.example").select("id"),
    "SELECT id FROM correspondence WHERE EXISTS (SELECT 1 FROM sender_rule WHERE 'hr@' || regexp_replace(value, '^hr@', '') IN (lower(a1), lower(a2)))",
)
add(
    "people", lambda r: rs.people(r.message.join(r.correspondence.select("id", F.col("a2").alias("address")), "id").select("id", "company_id", "address", "sent_at"), "p0@s0.example"),
    "SELECT company_id, a2 AS address, CAST(NULL AS VARCHAR) AS automated, count(*) AS n, min(sent_at) AS first_at, max(sent_at) AS last_at FROM message JOIN correspondence USING (id) WHERE a2 <> 'p0@s0.example' GROUP BY 1, 2",
)
_LOOSE = "CASE WHEN classified_by IS NOT NULL THEN application_id END"
add(
    "derivation_chain", lambda r: rs.derivation_chain(r.message.withColumn("application_id", F.expr(_LOOSE)).withColumn("company_id", F.col("company_id"))),
    f""", m AS (SELECT id, company_id, {_LOOSE} AS application_id FROM message), big AS (SELECT company_id, application_id FROM m WHERE application_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
SELECT application_id, id FROM m WHERE application_id IS NOT NULL UNION ALL SELECT b.application_id, m.id FROM m JOIN big b ON b.company_id = m.company_id WHERE m.application_id IS NULL AND (SELECT count(*) FROM big x WHERE x.company_id = m.company_id) = 1""",
)
add(
    "relink_evidence", lambda r: rs.relink_evidence(r.message, r.message.filter("classified_by = 'model-x'").select("id", (F.col("company_id") + F.expr("CASE WHEN length(sender_domain) > 11 THEN 0 ELSE 1 END")).alias("target")), r.company.withColumn("domain", F.expr("concat('s', CAST(id % 100 AS STRING), '.example')"))),
    """, t AS (SELECT id, thread_id, sender_domain, company_id + CASE WHEN length(sender_domain) > 11 THEN 0 ELSE 1 END AS target FROM message WHERE classified_by = 'model-x')
SELECT t.id, CASE WHEN sender_domain = concat('s', CAST(c.id % 100 AS STRING), '.example') THEN 'sender domain' WHEN EXISTS (SELECT 1 FROM message o WHERE o.thread_id = t.thread_id AND o.company_id = t.target AND o.id <> t.id) THEN 'thread' END AS evidence FROM t LEFT JOIN company c ON c.id = t.target""",
)
add("newest_subjects", lambda r: rs.top_rows(r.message.select("id", "company_id", "sent_at"), "company_id", "sent_at", 5), "SELECT id, company_id, sent_at FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY sent_at DESC, id) AS k FROM message) WHERE k <= 5")
# mutations


def _rules_new(r):
    return r.sender_rule.withColumn("value", F.expr("replace(value, '.example', CASE WHEN length(value) % 2 = 0 THEN '.example' ELSE '.test' END)")).withColumn("source", F.lit("new"))


add("insert_absent", lambda r: mutate.insert_absent(r.sender_rule, _rules_new(r), ["match_type", "value"]), """, n AS (SELECT match_type, replace(value, '.example', CASE WHEN length(value) % 2 = 0 THEN '.example' ELSE '.test' END) AS value, verdict, category, company_id, 'new' AS source FROM sender_rule)
SELECT * FROM sender_rule UNION ALL SELECT match_type, value, verdict, category, company_id, source FROM n WHERE NOT EXISTS (SELECT 1 FROM sender_rule r WHERE r.match_type = n.match_type AND r.value = n.value)""")
add(
    "upsert_widen", lambda r: mutate.upsert(r.message.filter("direction = 'inbound'").groupBy("company_id").agg(F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at")), r.message.filter("direction = 'outbound'").groupBy("company_id").agg(F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at")), ["company_id"], least=["first_at"], greatest=["last_at"]),
    "SELECT company_id, min(sent_at) AS first_at, max(sent_at) AS last_at FROM message GROUP BY 1",
)
add("last_writer", lambda r: mutate.last_writer(r.message.filter("direction = 'inbound'").groupBy("thread_id").agg(F.max("sent_at").alias("at"), F.lit("in").alias("by")), r.message.filter("direction = 'outbound'").groupBy("thread_id").agg(F.max("sent_at").alias("at"), F.lit("out").alias("by")), ["thread_id"], "at"), "SELECT thread_id, max(sent_at) AS at, CASE WHEN max(sent_at) FILTER (direction = 'outbound') = max(sent_at) THEN 'out' ELSE 'in' END AS by FROM message GROUP BY 1")


def _merging(r):
    return r.application.filter("id % 10 = 1").select(F.col("id").alias("old"), (F.col("id") - 1).alias("new"))


add("merge_applications", lambda r: mutate.merge_applications(r.application, r.stage_event, r.message, _merging(r))[0], """SELECT a.id, a.company_id, coalesce(a.role_title, b.role_title) AS role_title, a.started_at, coalesce(a.outcome, b.outcome) AS outcome, coalesce(a.derived_at, b.derived_at) AS derived_at
FROM application a LEFT JOIN application b ON a.id % 10 = 0 AND b.id = a.id + 1 WHERE a.id % 10 <> 1""")
add("merge_application_events", lambda r: mutate.merge_applications(r.application, r.stage_event, r.message, _merging(r))[1].select("id", "application_id", "stage"), """, moved AS (SELECT id, stage, occurred_at, evidence_message_id, CASE WHEN application_id % 10 = 1 THEN application_id - 1 ELSE application_id END AS application_id FROM stage_event)
SELECT id, application_id, stage FROM moved m WHERE NOT (stage = 'offer' AND application_id % 10 = 0 AND EXISTS (SELECT 1 FROM application a WHERE a.id = m.application_id + 1) AND occurred_at >= coalesce((SELECT min(occurred_at) FROM moved x WHERE x.application_id = m.application_id AND x.stage = 'accepted'), TIMESTAMP '9999-01-01'))""")
add("delete_companies_mail", lambda r: mutate.delete_companies(r.company, r.application, r.stage_event, r.message, r.company.filter("kind = 'agency'").select("id"))[3].select("id", "company_id", "application_id", "classified_by"), "SELECT m.id, CASE WHEN kind <> 'agency' THEN company_id END AS company_id, CASE WHEN kind <> 'agency' THEN application_id END AS application_id, CASE WHEN kind <> 'agency' THEN classified_by END AS classified_by FROM message m JOIN company c ON c.id = m.company_id")
add("delete_companies_events", lambda r: mutate.delete_companies(r.company, r.application, r.stage_event, r.message, r.company.filter("kind = 'agency'").select("id"))[2].select("id", "application_id"), "SELECT id, application_id FROM stage_event WHERE application_id NOT IN (SELECT a.id FROM application a JOIN company c ON c.id = a.company_id WHERE kind = 'agency')")
_STAMP = datetime(2003, 1, 1)
add("append_generation", lambda r: mutate.append_generation(r.application, r.stage_event, r.stage_event.filter("stage = 'offer'").drop("derived_at"), r.application.filter("id % 4 = 0").select(F.col("id").alias("application_id")), _STAMP)[0].select("id", "derived_at"), "SELECT id, CASE WHEN id % 4 = 0 OR id IN (SELECT application_id FROM stage_event WHERE stage = 'offer') THEN TIMESTAMP '2003-01-01' ELSE derived_at END AS derived_at FROM application")
add("resolve_reviews", lambda r: mutate.resolve_reviews(r.review_queue, r.message.filter("direction = 'outbound'").select(F.col("id").alias("message_id"), F.lit("approved").alias("status"))).select("id", "status"), "SELECT q.id, CASE WHEN q.status = 'pending' AND m.direction = 'outbound' THEN 'approved' ELSE q.status END AS status FROM review_queue q JOIN message m ON m.id = q.message_id")
# search
_TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_HAS = "list_contains(t, '{0}')"
_LN = "ln(1 + len(list_filter(t, lambda x: x = '{0}')))"
#: Kept indexes, by application and folder: the searches below share one.
_INDEXES: dict = {}


def _index(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = search.TextIndex.build(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", f"{shared_dir(spark)}/text")
    return _INDEXES[key]


QUERIES["full_text_search"] = lambda spark, sf_dir: _index(spark, sf_dir).search("license OR token version -gpl", stemmed=False).select("id", F.round("rank", 6).alias("rank"))
ORACLES["full_text_search"] = (
    f"SELECT doc_id AS id, round({' + '.join(_LN.format(w) for w in ('license', 'token', 'version'))}, 6) AS rank FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE ({_HAS.format('license')} OR {_HAS.format('token')}) AND {_HAS.format('version')} AND NOT {_HAS.format('gpl')}")
QUERIES["full_text_phrase"] = lambda spark, sf_dir: _index(spark, sf_dir).search('"licensed under the" -apache', stemmed=False).select("id", F.round("rank", 6).alias("rank"))
ORACLES["full_text_phrase"] = (
    f"SELECT doc_id AS id, round({' + '.join(_LN.format(w) for w in ('licensed', 'under', 'the'))}, 6) AS rank FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' licensed under the ') AND NOT {_HAS.format('apache')}")
def _add_text(name, query, sql):
    QUERIES[name] = lambda spark, sf_dir: _index(spark, sf_dir).search(query).select("id", F.round("rank", 6).alias("rank"))
    ORACLES[name] = f"SELECT doc_id AS id, round({sql[0]}, 6) AS rank FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE {sql[1]}"


# the forms of each stem that an English text can have
_FORM = {"licens": "license licensed licenses licensing", "token": "token tokens tokenize tokenized", "version": "version versions", "grant": "grant grants granted granting"}
_ANY = lambda s: "len(list_intersect(t, [" + ", ".join(f"'{w}'" for w in _FORM[s].split()) + "])) > 0"
_LOG = lambda s: "ln(1 + len(list_filter(t, lambda x: x IN (" + ", ".join(f"'{w}'" for w in _FORM[s].split()) + "))))"
_add_text("stemmed_search", "licensing versions OR tokens -granting", (" + ".join(map(_LOG, ("licens", "token", "version"))), f"{_ANY('licens')} AND ({_ANY('version')} OR {_ANY('token')}) AND NOT {_ANY('grant')}"))
_PHRASE = "len(list_filter(range(1, len(t) - 1), lambda i: t[i] IN ('license', 'licensed', 'licenses', 'licensing') AND t[i + 1] = 'under' AND t[i + 2] = 'the')) > 0"
QUERIES["stemmed_phrase"] = lambda spark, sf_dir: _index(spark, sf_dir).search('"licensing under the" -tokens').select("id")
ORACLES["stemmed_phrase"] = f"SELECT doc_id AS id FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE {_PHRASE} AND NOT {_ANY('token')}"
add_table("postings", "documents", lambda t: search.postings(t, "doc_id", "text").select("term", "id", "tf"), f"SELECT term, doc_id AS id, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY 1, 2")


# every hundredth row asks all rows
_COS = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_ASKS = lambda t: t.filter("vec_id % 100 = 0")


def _add_search(name, build, k, where):
    add_table(
        name, "embeddings", lambda t: build(t).withColumn("similarity", F.round("similarity", 6)),
        f"""SELECT query, rank, id, round(similarity, 6) AS similarity FROM (SELECT query, id, similarity, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 12) DESC, id) AS rank FROM (
  SELECT q.vec_id AS query, v.vec_id AS id, {_COS} AS similarity FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND q.embedding IS NOT NULL AND v.embedding IS NOT NULL AND {where})) WHERE rank <= {k}""",
    )


_add_search("semantic_search", lambda t: search.semantic(t, _ASKS(t), 10), 10, "true")
_add_search("semantic_neighbours", lambda t: search.neighbours(t, _ASKS(t), 10), 10, "v.vec_id <> q.vec_id")
_add_search("similar_resolved", lambda t: search.semantic(t, _ASKS(t), 5, where=F.col("label") > 3), 5, "v.label > 3")
add_table("embedding_text", "documents", lambda t: t.select("doc_id", F.md5(search.embedding_text(F.when(F.col("lang") != "de", F.col("text")), F.col("source")).cast("binary")).alias("digest")), "SELECT doc_id, md5(coalesce(nullif(trim(CASE WHEN lang <> 'de' THEN text END), ''), nullif(trim(source), ''), '(empty)')) AS digest FROM documents")
# quality
add(
    "constraint_violations", quality.violations,
    """SELECT 'stage_event.before_start' AS rule, e.id AS key FROM stage_event e JOIN application a ON a.id = e.application_id WHERE e.occurred_at < a.started_at
UNION ALL SELECT 'message.id', id FROM message GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'review_queue.one_pending', message_id FROM review_queue WHERE status = 'pending' GROUP BY message_id HAVING count(*) > 1
UNION ALL SELECT 'company.domain', domain FROM company WHERE domain IS NOT NULL GROUP BY domain HAVING count(*) > 1 UNION ALL SELECT 'company.name', CAST(id AS VARCHAR) FROM company WHERE trim(canonical_name) = ''""",
)


def _predictions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    text = F.lower("text")
    has = lambda w: F.contains(text, F.lit(w))
    return docs.join(labels, "doc_id").select((F.col("quality") == 1).alias("gold"), (F.length("text") > 300).alias("predicted"), (F.length("text") > 200).alias("resolved"), has("the").alias("the"), has("que").alias("que"), has("und").alias("und"), F.lit(True).alias("all"))


QUERIES["scorecard"] = lambda spark, sf_dir: quality.scorecard(_predictions(spark, sf_dir), resolved="resolved")
_GOLD = "g AS (SELECT quality = 1 AS g, length(text) > 300 AS p, length(text) > 200 AS r, contains(lower(text), 'the') AS f0, contains(lower(text), 'que') AS f1, contains(lower(text), 'und') AS f2 FROM documents JOIN labels USING (doc_id))"
ORACLES["scorecard"] = f"""WITH {_GOLD}, c AS (SELECT count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, count(*) FILTER (NOT p AND NOT g) AS tn, count(*) FILTER (r) / count(*) AS rr FROM g)
SELECT tp, fp, fn, tn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1, rr AS resolution_rate, tn / (tn + fp) AS noise_accuracy FROM c"""
QUERIES["retrieval_scorecard"] = lambda spark, sf_dir: quality.retrieval_scorecard(_predictions(spark, sf_dir), ["the", "que", "und", "all"], "gold")
ORACLES["retrieval_scorecard"] = f"""WITH {_GOLD}, e AS (SELECT g, 0 AS layer, 'the' AS family, f0 AS hit FROM g UNION ALL SELECT g, 1, 'que', f0 OR f1 FROM g UNION ALL SELECT g, 2, 'und', f0 OR f1 OR f2 FROM g UNION ALL SELECT g, 3, 'all', true FROM g)
SELECT layer, family, count(*) FILTER (hit) AS fetched, count(*) FILTER (hit) / count(*) AS share, count(*) FILTER (hit AND g) / count(*) FILTER (g) AS recall, coalesce(count(*) FILTER (hit AND g) / nullif(count(*) FILTER (hit), 0), 0) AS precision FROM e GROUP BY 1, 2"""
add("embedding_coverage", lambda r: r.message.agg(F.count(F.lit(1)).alias("total"), F.count("classified_by").alias("covered")), "SELECT count(*) AS total, count(classified_by) AS covered FROM message")
add("latest_review_of_domain", lambda r: lists.latest(r.review_queue.join(r.message.select(F.col("id").alias("message_id"), "sender_domain"), "message_id"), "sender_domain", "created_at", "id", "reason"), "SELECT sender_domain, id, reason, created_at FROM (SELECT q.*, m.sender_domain, row_number() OVER (PARTITION BY sender_domain ORDER BY q.created_at DESC, q.id DESC) AS k FROM review_queue q JOIN message m ON m.id = q.message_id) WHERE k = 1")
_GONE = lambda r: r.company.filter("kind = 'agency'").select("id")
add("mark_negative", lambda r: mutate.mark_negative(r.message, r.message.select(F.col("id").alias("message_id"), "company_id"), _GONE(r))[0].select("id", "company_id", "application_id", "classified_by"), "SELECT m.id, CASE WHEN kind <> 'agency' THEN company_id END AS company_id, CASE WHEN kind <> 'agency' THEN application_id END AS application_id, CASE WHEN kind <> 'agency' THEN classified_by ELSE 'rule:negative' END AS classified_by FROM message m JOIN company c ON c.id = m.company_id")
_PLAN = lambda r: r.message.filter("direction = 'outbound'").select("id", F.when(F.col("classified_by").isNull(), "relink").otherwise("unlink").alias("action"), (F.col("company_id") + 1).alias("target"))
add("apply_audit", lambda r: mutate.apply_audit(r.message, r.stage_event, _PLAN(r))[0].select("id", "company_id", "application_id"), "SELECT id, CASE WHEN direction <> 'outbound' THEN company_id WHEN classified_by IS NULL THEN company_id + 1 END AS company_id, CASE WHEN direction <> 'outbound' THEN application_id END AS application_id FROM message")
add("apply_audit_events", lambda r: mutate.apply_audit(r.message, r.stage_event, _PLAN(r))[1].select("id", "stage"), "SELECT e.id, e.stage FROM stage_event e JOIN message m ON m.id = e.evidence_message_id WHERE m.direction <> 'outbound'")
_TALKS = lambda r: r.application.filter("id % 6 = 0").select(F.col("id").cast("string").alias("id"), F.col("id").alias("application_id"), (F.col("started_at") + F.expr("INTERVAL 60 DAYS")).alias("occurred_at"), F.expr("CASE id % 4 WHEN 0 THEN 'accepted' WHEN 2 THEN 'offer' END").alias("stage"))
add("record_conversations", lambda r: mutate.record_conversations(_TALKS(r), r.application, r.stage_event, TERMINAL_STAGES)[0].select("id", "outcome"), """SELECT id, CASE WHEN id % 12 = 0 AND started_at + INTERVAL 60 DAY >= coalesce((SELECT max(occurred_at) FROM stage_event e WHERE e.application_id = a.id AND e.stage IN ('rejected', 'withdrawn', 'accepted', 'declined')), TIMESTAMP '1900-01-01') THEN 'accepted' ELSE outcome END AS outcome FROM application a""")
add("record_conversation_events", lambda r: mutate.record_conversations(_TALKS(r), r.application, r.stage_event, TERMINAL_STAGES)[1].select("id", "application_id", "stage", "derived_at"), "SELECT id, application_id, stage, derived_at FROM stage_event UNION ALL SELECT concat('talk-', id), id, CASE id % 4 WHEN 0 THEN 'accepted' ELSE 'offer' END, derived_at FROM application WHERE id % 6 = 0 AND id % 4 IN (0, 2)")
