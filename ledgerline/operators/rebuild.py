"""The whole record derived anew from its archive, into a snapshot that takes the old one's place when it is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import normalize as nz
from ledgerline.sources import envelopes as env
from ledgerline.storage import stage
from ledgerline.streaming.versions import Versions

from . import resolve, upkeep
from .graphs import components
from .stages import forward_order


def thread_roots(mail: DataFrame) -> DataFrame:
    """(storage_key, thread_id): messages that headers connect, over any number of steps, also through messages that were never seen.

    A thread is named after the smallest of its header identifiers; a message without any is a thread of its own. Subjects play no part.
    mail: storage_key, message_id_header, in_reply_to, references_ids.
    """
    own = F.coalesce("message_id_header", F.concat(F.lit("#"), "storage_key"))
    rows = mail.select("storage_key", own.alias("own"), F.array_distinct(F.filter(F.concat(F.array("in_reply_to"), F.coalesce("references_ids", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))).alias("above"))
    links = rows.select(F.col("own").alias("a"), F.explode("above").alias("b")).filter("a <> b").distinct()
    roots = components(links)
    return rows.join(roots.withColumnRenamed("node", "own"), "own", "left").select("storage_key", F.coalesce("root", "own").alias("thread_id"))


def derive(archive: DataFrame, readings: DataFrame, own_address: str = "") -> dict[str, tuple[DataFrame, list[str]]]:
    """All tables of the record with their keys, from envelopes and what was read of them: messages, threads, contacts, links, companies, applications, stages.

    readings: message_id_header, label, company_name, company_domain, role_title, stage. Identifiers are hashes of what they name, so that a second derivation
    of the same archive gives the same tables.
    """
    parsed = stage(env.parse_messages(archive))
    threads = stage(thread_roots(parsed))
    mail = parsed.join(threads, "storage_key").withColumn("id", F.md5(F.col("storage_key").cast("binary")))
    read = mail.select("id", "message_id_header", "sent_at").join(readings.filter("label = 'positive'"), "message_id_header").filter(nz.names_a_company(F.col("company_name"), F.col("company_domain")))
    mentions = stage(read.select("id", F.col("company_name").alias("name"), F.lower("company_domain").alias("domain"), F.col("sent_at").alias("at"), "role_title", "stage"))
    made = resolve.create_companies(mentions.select("id", "name", "domain", "at"))
    companies = stage(made.select(F.abs(F.xxhash64("first_id")).alias("id"), F.col("name").alias("canonical_name"), "domain"))
    found = resolve.lookup_companies(mentions.select("id", "name", "domain"), companies, resolve.company_aliases(companies))
    told = stage(mentions.join(found.filter("company_id IS NOT NULL"), "id"))
    ends = F.col("stage").isin("rejected", "withdrawn", "accepted", "declined")
    assigned = stage(resolve.assign_applications(told.select("id", "company_id", F.col("role_title").alias("role"), "at", F.coalesce(ends, F.lit(False)).alias("ends"))))
    linked = told.join(assigned.select("id", "application"), "id").withColumn("application_id", F.abs(F.xxhash64("application")))
    applications = linked.groupBy("application_id", "company_id").agg(F.min_by("role_title", F.struct(F.col("role_title").isNull(), "at", "id")).alias("role_title"), F.min("at").alias("started_at"))
    events = linked.filter("stage IS NOT NULL").select("id", "application_id", "stage", F.col("at").alias("occurred_at"))
    messages = mail.join(linked.select("id", "company_id", "application_id"), "id", "left")
    messages = stage(messages.select("id", "storage_key", "thread_id", "sent_at", "direction", "subject", "sender_address", "message_id_header", "company_id", "application_id"))
    of_threads = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("direction") == "outbound").alias("sent"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))
    none = archive.sparkSession.createDataFrame
    contacts, links = upkeep.resolve_contacts(
        none([], "contact_id string, identifier string"), none([], "contact_id string, company_id long, first_at timestamp, last_at timestamp"), messages.select(F.col("sender_address").alias("address"), "company_id", "sent_at"), own_address
    )
    return {
        "messages": (messages, ["id"]), "threads": (of_threads, ["thread_id"]), "contacts": (contacts, ["contact_id"]), "links": (links, ["contact_id", "company_id"]), "companies": (companies, ["id"]),
        "applications": (applications, ["application_id"]), "stages": (forward_order(events), ["id"]),
    }


def rebuild_record(archive: DataFrame, readings: DataFrame, versions: Versions, own_address: str = "") -> int:
    """Derive the record into the next version; readers keep the one they have until the new one is whole. Gives its number."""
    number = versions.latest() + 1
    versions.replace(number, derive(archive, readings, own_address))
    return number
