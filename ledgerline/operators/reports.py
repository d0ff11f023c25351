"""Reports over the record: chains, timelines, dossiers, facts, runs, details."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import normalize as nz

from .scope import current_events, latest, latest_stage


def render_chain(rows: DataFrame, key: str = "application_id", position: str = "idx", subject: str = "subject", cut: int = 160) -> DataFrame:
    """(key, chain): one numbered line a message, in order, subjects cut."""
    line = F.format_string("%d. [%s] %s", F.col(position), "direction", F.substring(F.coalesce(subject, F.lit("")), 1, cut))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), line.alias("l")))), lambda x: x["l"]), "\n").alias("chain"))


def chain_digest(rows: DataFrame, key: str = "application_id", tail: int = 4, cut: int = 160, snippet: int = 300) -> DataFrame:
    """(key, digest): a numbered, dated line a message, with the start of the body under the last few and under outcome-like subjects.

    rows: the key, idx (order), sent_at, direction, sender, subject, body. Lines and starts of bodies alone are gathered, no bodies.
    """
    said = lambda c, instead: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(instead))
    subject = F.replace(said(F.col("subject"), "(no subject)"), F.lit("\n"), F.lit(" "))
    body = F.substring(F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+", " ")), 1, snippet)
    line = F.concat(F.coalesce(F.date_format("sent_at", "yyyy-MM-dd"), F.lit("unknown-date")), F.when(F.col("direction") == "outbound", " -> ").otherwise(" <- "), said(F.col("sender"), "?"), F.lit(": "), F.substring(subject, 1, cut))
    one = F.struct(F.col("idx").alias("p"), line.alias("line"), F.when(body != "", body).alias("body"), F.regexp_like(subject, F.lit(nz.OUTCOME_SUBJECT)).alias("outcome"))
    chains = rows.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("c"))
    shown = lambda m, i: m["body"].isNotNull() & (m["outcome"] | (i >= F.size("c") - tail))
    text = lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), m["line"], F.when(shown(m, i), F.concat(F.lit("\n     | "), m["body"])).otherwise(""))
    return chains.select(key, F.array_join(F.transform("c", text), "\n").alias("digest"))


def company_timelines(rec) -> DataFrame:
    """(company_id, applications, messages, unlinked, claims, first_at, last_at, years): all companies at once."""
    mail = rec.message.groupBy("company_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("application_id").isNull()).alias("unlinked"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))
    apps = rec.application.groupBy("company_id").agg(F.count(F.lit(1)).alias("applications"))
    claims = current_events(rec).groupBy("company_id").agg(F.count(F.lit(1)).alias("claims"))
    rows = rec.company.select(F.col("id").alias("company_id")).join(mail, "company_id", "left").join(apps, "company_id", "left").join(claims, "company_id", "left")
    return rows.fillna(0, ["messages", "unlinked", "applications", "claims"]).withColumn("years", F.year("last_at") - F.year("first_at") + 1)


def timeline_entries(rec, contacts: DataFrame | None = None) -> DataFrame:
    """(company_id, kind, application_id, at, name, evidence): what each company's timeline is made of, a row an entry.

    Applications with what settled them, the claims of the generation that each application shows, with their evidence, and people (contacts: company_id, identifier). Rows, and no nested
    arrays: a company with a large share of all mail has as many as it needs, and a page of one company is a filter.
    """
    none = lambda kind: F.lit(None).cast(kind)
    apps = rec.application.select("company_id", F.lit("application").alias("kind"), F.col("id").alias("application_id"), F.col("started_at").alias("at"), F.coalesce("outcome", "role_title").alias("name"), none("string").alias("evidence"))
    claims = current_events(rec).select("company_id", F.lit("claim").alias("kind"), "application_id", F.col("occurred_at").alias("at"), F.col("stage").alias("name"), F.col("evidence_message_id").alias("evidence"))
    out = apps.unionByName(claims)
    if contacts is not None:
        people = contacts.select("company_id", F.lit("person").alias("kind"), none("long").alias("application_id"), none(claims.schema["at"].dataType).alias("at"), F.col("identifier").alias("name"), none("string").alias("evidence")).distinct()
        out = out.unionByName(people)
    return out


def fingerprints(rec) -> DataFrame:
    """(company_id, fingerprint) that changes when a company's mail or stages do."""
    mail = rec.message.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.max("sent_at").alias("sent"))
    stage = current_events(rec).groupBy("company_id").agg(F.max("occurred_at").alias("moved"))
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))
    return mail.join(stage, "company_id", "left").select("company_id", F.sha2(F.concat_ws(":", F.col("company_id").cast("string"), F.col("n").cast("string"), text("sent"), text("moved")), 256).alias("fingerprint"))


def stale(fresh: DataFrame, cache: DataFrame, key: str = "company_id") -> DataFrame:
    """Keys whose cached summary is missing or was made of other data."""
    return fresh.join(cache.select(key, F.col("fingerprint").alias("_cached")), key, "left").filter(~F.col("fingerprint").eqNullSafe(F.col("_cached"))).select(key)


def stage_movement(rec, since: datetime) -> DataFrame:
    """(stage, company_id, n) of current events since a time."""
    return current_events(rec).filter(F.col("occurred_at") >= F.lit(since)).groupBy("stage", "company_id").agg(F.count(F.lit(1)).alias("n"))


def new_companies(rec, since: datetime) -> DataFrame:
    """(company_id, first_at): companies whose first message is not before a time."""
    return rec.message.groupBy("company_id").agg(F.min("sent_at").alias("first_at")).filter((F.col("first_at") >= F.lit(since)) & F.col("company_id").isNotNull())


def mailbox_facts(rec) -> DataFrame:
    """One row: employers, agencies, applications, messages, and the share classified without a model."""
    free = F.count_if(F.col("classified_by").isNotNull() & ~F.col("classified_by").like("model%"))
    mail = rec.message.agg(F.count(F.lit(1)).alias("messages"), (free / F.nullif(F.count("classified_by"), F.lit(0))).alias("free_share")).withColumn("_one", F.lit(1))
    firms = rec.company.agg(F.count_if(F.col("kind") == "employer").alias("employers"), F.count_if(F.col("kind") == "agency").alias("agencies")).withColumn("_one", F.lit(1))
    apps = rec.application.agg(F.count(F.lit(1)).alias("applications")).withColumn("_one", F.lit(1))
    return mail.join(firms, "_one").join(apps, "_one").drop("_one")


def company_dossiers(rec, senders: int = 4, newest: int = 5) -> DataFrame:
    """(company_id, messages, senders, newest, applications): what an audit reads of a company.

    Only the first few senders and messages are kept while aggregating, so a busy company stays a small row.
    """
    who = rec.message.select("company_id", "sender_domain").distinct().withColumn("n", F.row_number().over(Window.partitionBy("company_id").orderBy("sender_domain"))).filter(F.col("n") <= senders)
    who = who.groupBy("company_id").agg(F.array_join(F.sort_array(F.collect_list("sender_domain")), ",").alias("senders"))
    top = rec.message.withColumn("n", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("sent_at"), "id"))).filter(F.col("n") <= newest)
    top = top.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]), ",").alias("newest"))
    apps = rec.application.groupBy("company_id").agg(F.count(F.lit(1)).alias("applications"))
    mail = rec.message.groupBy("company_id").agg(F.count(F.lit(1)).alias("messages"))
    return mail.join(who, "company_id").join(top, "company_id").join(apps, "company_id", "left")


def application_dossiers(rec) -> DataFrame:
    """(application_id, stages): the current stages of an application in order."""
    return current_events(rec).groupBy("application_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("occurred_at", "id", "stage"))), lambda x: x["stage"]), " > ").alias("stages"))


def tally(hits: DataFrame, rec) -> DataFrame:
    """(company_id, canonical_name, n) of a hit list of messages, the most first."""
    rows = hits.join(rec.message.select("id", "company_id"), "id").groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).join(rec.company.select(F.col("id").alias("company_id"), "canonical_name"), "company_id")
    return rows.orderBy(F.desc("n"), "canonical_name", "company_id")


def run_report(runs: DataFrame, now: datetime, silent_after: int = 20) -> DataFrame:
    """Runs with elapsed seconds, rate, seconds to go and whether they stalled; active ones first.

    runs: id, started_at, finished_at, last_beat, done, total.
    """
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    active = F.col("finished_at").isNull()
    elapsed = seconds(F.coalesce("finished_at", F.lit(now))) - seconds(F.col("started_at"))
    rows = runs.withColumn("active", active).withColumn("elapsed", elapsed).withColumn("per_minute", F.when(F.col("elapsed") > 0, F.col("done") * 60 / F.col("elapsed")))
    rows = rows.withColumn("to_go", F.when(active & (F.col("per_minute") > 0), (F.col("total") - F.col("done")) * 60 / F.col("per_minute")))
    return rows.withColumn("stalled", active & (seconds(F.lit(now)) - seconds(F.col("last_beat")) > silent_after)).orderBy(F.desc("active"), F.desc("started_at"), "id")


def thread_inputs(rec, most: int = 6) -> DataFrame:
    """(thread_id, id, members, senders, began): the newest message of each thread and what surrounds it."""
    top = latest(rec.message, "thread_id", "sent_at", "id")
    who = rec.message.select("thread_id", "sender_domain").distinct().withColumn("n", F.row_number().over(Window.partitionBy("thread_id").orderBy("sender_domain"))).filter(F.col("n") <= most)
    who = who.groupBy("thread_id").agg(F.array_join(F.sort_array(F.collect_list("sender_domain")), ",").alias("senders"))
    size = rec.message.groupBy("thread_id").agg(F.count(F.lit(1)).alias("members"), F.min("sent_at").alias("began"))
    return size.join(top.select("thread_id", "id"), "thread_id").join(who, "thread_id")


def fresh_readings(readings: DataFrame, rec) -> DataFrame:
    """Readings that cover their thread's newest message. readings: thread_id, covers_sent_at."""
    newest = rec.message.groupBy("thread_id").agg(F.max("sent_at").alias("_newest"))
    return readings.join(newest, "thread_id").filter(F.col("covers_sent_at") >= F.col("_newest")).drop("_newest")


def message_details(rec) -> DataFrame:
    """(id, canonical_name, role_title, evidence): messages with what they evidence, as stage and role."""
    role = rec.application.select(F.col("id").alias("application_id"), "role_title")
    claims = current_events(rec).join(role, "application_id").groupBy(F.col("evidence_message_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("/", "stage", F.coalesce("role_title", F.lit("-"))))), ",").alias("evidence"))
    rows = rec.message.join(rec.company.select(F.col("id").alias("company_id"), "canonical_name"), "company_id", "left").join(role, "application_id", "left").join(claims, "id", "left")
    return rows.select("id", "canonical_name", "role_title", F.coalesce("evidence", F.lit("")).alias("evidence"))


def enrichment_backlog(rec, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Companies with a domain and no answer for it, those with most mail first. done: company_id, domain."""
    held = done.select("company_id", F.col("domain").alias("_d"))
    mail = rec.message.groupBy("company_id").agg(F.count(F.lit(1)).alias("messages"))
    rows = rec.company.filter("domain IS NOT NULL").select(F.col("id").alias("company_id"), "domain").join(held, "company_id", "left").filter(~F.col("_d").eqNullSafe(F.lower("domain"))).drop("_d")
    out = rows.join(mail, "company_id", "left").fillna(0, ["messages"]).orderBy(F.desc("messages"), "company_id")
    return out if limit is None else out.limit(limit)


def find_company(rec, needle: str) -> DataFrame:
    """The company that a text names: exactly, by domain, or within its name, in this order."""
    low = needle.strip().lower()
    name, domain = F.lower("canonical_name"), F.lower("domain")
    kind = F.when(name == low, 0).when(domain == nz.normalise_domain(F.lit(low)), 1).when(F.contains(name, F.lit(low)), 2)
    return rec.company.withColumn("_k", kind).filter("_k IS NOT NULL").orderBy("_k", "id").limit(1).select("id", "canonical_name", "domain")


def verification_inputs(rec, verified: DataFrame, most: int = 60) -> DataFrame:
    """(company_id, id, n): the newest messages of companies not verified yet, numbered from the oldest."""
    rows = rec.message.filter("company_id IS NOT NULL").join(verified.select("company_id"), "company_id", "left_anti")
    back = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("sent_at"), F.desc("id")))
    rows = rows.withColumn("_b", back).filter(F.col("_b") <= most)
    return rows.select("company_id", "id", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("_b"))).alias("n"))


def silent_applications(rec) -> DataFrame:
    """(application_id, stage): latest stages, for timers that watch silence."""
    return latest_stage(rec).select("application_id", "stage")
