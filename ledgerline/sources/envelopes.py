"""The raw archive: envelopes in JSON lines, write-once storage, and parsing of their messages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import normalize as nz
from ledgerline.storage import stage

VERSION = 1
SCHEME = "raw-v1"
ENVELOPE = "v int, source string, external_id string, account string, fetched_at timestamp, payload_b64 string, metadata map<string,string>"


def read_envelopes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): envelopes of the known version with their payload, and lines that can't be read, told and not fatal."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    return split_envelopes(raw.select(F.col("value").alias("line")))


def split_envelopes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = lines.select("line", F.from_json("line", ENVELOPE).alias("e")).withColumn("payload", F.try_to_binary("e.payload_b64", F.lit("base64")))
    fine = F.coalesce((F.col("e.v") == VERSION) & F.col("payload").isNotNull() & F.col("e.source").isNotNull(), F.lit(False))
    good = parsed.filter(fine).select("e.source", "e.external_id", "e.account", "e.fetched_at", "payload", "e.metadata")
    return good, parsed.filter(~fine).select("line", F.when(F.col("e.v").isNull(), "not an envelope").when(F.col("e.v") != VERSION, "unknown version").otherwise("bad payload").alias("problem"))


def to_lines(envelopes: DataFrame) -> DataFrame:
    """One JSON object a line, keys in order."""
    return envelopes.select(F.to_json(F.struct("account", "external_id", "fetched_at", "metadata", F.base64("payload").alias("payload_b64"), "source", F.lit(VERSION).alias("v"))).alias("value"))


def with_keys(envelopes: DataFrame) -> DataFrame:
    """Envelopes with the hash of their content and the key that follows from it and the time of the message."""
    digest = nz.content_hash(F.col("source"), F.col("account"), F.col("payload"), SCHEME)
    at = F.try_to_timestamp(F.try_element_at("metadata", F.lit("occurred_at")))
    return envelopes.withColumn("content_hash", digest).withColumn("storage_key", nz.storage_key(F.col("source"), F.col("content_hash"), at)).withColumn("occurred_at", at)


def write_once(archive: DataFrame | None, new: DataFrame) -> DataFrame:
    """The envelopes of new that the archive doesn't hold, once each: the first fetched of equal content."""
    first = new.groupBy("storage_key").agg(F.min_by(F.struct(*[c for c in new.columns if c != "storage_key"]), F.struct("fetched_at", "external_id")).alias("_r")).select("storage_key", "_r.*").select(*new.columns)
    return first if archive is None else first.join(archive.select("storage_key"), "storage_key", "left_anti").select(*new.columns)


def ingest_counters(archive: DataFrame | None, new: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """One row: fetched, stored, already_stored, rows_inserted, rows_existing; a second run stores and inserts nothing."""
    keys = new.select("storage_key")
    held = lambda df, name: (df.select("storage_key").distinct() if df is not None else keys.limit(0)).withColumn(name, F.lit(True))
    once = keys.groupBy("storage_key").agg(F.count(F.lit(1)).alias("n")).join(held(archive, "in_archive"), "storage_key", "left").join(held(messages, "in_rows"), "storage_key", "left")
    return once.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("fetched"), F.count_if(F.col("in_archive").isNull()).alias("stored"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("_n") - F.count_if(F.col("in_archive").isNull()),
        F.count_if(F.col("in_rows").isNull()).alias("rows_inserted"), F.count_if(F.col("in_rows").isNotNull()).alias("rows_existing"),
    ).toDF("fetched", "stored", "already_stored", "rows_inserted", "rows_existing")


def fresh_for_day(listing: DataFrame, messages: DataFrame, day: str) -> DataFrame:
    """What a day lists and the account doesn't have yet. listing: channel, account, external_id, occurred_at."""
    of_day = listing.filter((F.col("occurred_at") >= F.lit(day).cast("timestamp")) & (F.col("occurred_at") < F.lit(day).cast("timestamp") + F.expr("INTERVAL 1 DAY")))
    return of_day.join(messages.select("channel", "account", "external_id"), ["channel", "account", "external_id"], "left_anti")


def days_to_run(spark: SparkSession, since: str, until: str, runs: DataFrame) -> DataFrame:
    """(day): days of a backfill without a successful run. runs: day, failed."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"))).alias("day"))
    return days.join(runs.filter("NOT failed").select("day"), "day", "left_anti")


PARSED = "storage_key string, account string, fetched_at timestamp, date string, subject string, message_id string, in_reply_to string, references string, reply_to string, senders array<string>, tos array<string>, ccs array<string>, bulk boolean, plain string, html string, headers string, broken boolean"

# Headers that are kept with a message, up to 500 characters of each.
KEPT_HEADERS = ("Return-Path", "Delivered-To", "Authentication-Results", "Received-SPF", "List-Unsubscribe", "Precedence", "X-Mailer", "X-SG-EID", "X-Entity-ID", "X-Mailgun-Sid", "X-SES-Outgoing")
HEADER_CUT = 500


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Headers and body parts with the standard mail parser; what can't be parsed gives empty fields and says so."""
    from email import headerregistry, message_from_bytes, policy
    from email.utils import getaddresses, parsedate_to_datetime

    class Registry(headerregistry.HeaderRegistry):
        """The standard one, which makes a class for each header it reads; here one for each name."""

        __getitem__ = lru_cache(1024)(headerregistry.HeaderRegistry.__getitem__)

    # headers don't change once read, and most of those that are long to read come again and again
    reading = policy.default.clone(header_factory=lru_cache(4096)(Registry()))

    names = [c.split()[0] for c in PARSED.split(", ")]

    def text(message, name):
        value = message.get(name)
        return str(value) if value is not None else None

    def addresses(message, name):
        return [a for _, a in getaddresses([str(v) for v in message.get_all(name, [])]) if a]

    def one(payload):
        try:
            message = message_from_bytes(bytes(payload), policy=reading)
            date = text(message, "Date")
            try:
                sent = parsedate_to_datetime(date) if date else None
                # a time without a zone is UTC, whatever the session's zone
                date = sent and (sent if sent.tzinfo else sent.replace(tzinfo=UTC)).isoformat()
            except (TypeError, ValueError):
                date = None
            bodies = {}
            for kind in ("plain", "html"):
                part = message.get_body(preferencelist=(kind,))
                content = part.get_content() if part is not None else None
                bodies[kind] = content if isinstance(content, str) else None
            bulk = message.get("List-Unsubscribe") is not None or str(message.get("Precedence", "")).strip().lower() in ("bulk", "list")
            held = {name: str(message[name]).strip() for name in KEPT_HEADERS if message[name] is not None}
            headers = json.dumps({name: value[:HEADER_CUT] for name, value in held.items() if value})
            return (date, text(message, "Subject"), text(message, "Message-ID"), text(message, "In-Reply-To"), text(message, "References"), text(message, "Reply-To"), addresses(message, "From"), addresses(message, "To"), addresses(message, "Cc"), bulk, bodies["plain"], bodies["html"], None if headers == "{}" else headers, False)
        except Exception:  # noqa: BLE001  an archive holds mail of every broken client
            return (*[None] * 6, [], [], [], False, None, None, None, True)

    for pdf in batches:
        yield pd.DataFrame([(k, a, f, *one(p)) for k, a, f, p in zip(pdf["storage_key"], pdf["account"], pdf["fetched_at"], pdf["payload"], strict=True)], columns=names)


def parse_messages(envelopes: DataFrame) -> DataFrame:
    """Message rows: times, direction, addresses, threading headers, kept headers (a JSON object), bulk flag and body text. One Python pass reads MIME; the rest are expressions."""
    rows = envelopes.select("storage_key", "account", "fetched_at", "payload").mapInPandas(_parse, PARSED)
    lower = lambda c: F.transform(c, lambda a: F.lower(a))
    others = F.array_distinct(F.filter(lower(F.concat("tos", "ccs")), lambda a: a != F.lower("account")))
    sender = F.try_element_at(lower(F.col("senders")), F.lit(1))
    return rows.select(
        "storage_key", "account", F.coalesce(F.try_to_timestamp("date"), F.col("fetched_at")).alias("sent_at"), nz.direction(F.col("senders"), F.col("account")).alias("direction"),
        "subject", F.col("message_id").alias("message_id_header"), "in_reply_to", F.filter(F.split(F.coalesce("references", F.lit("")), r"\s+"), lambda x: x != "").alias("references_ids"),
        sender.alias("sender_address"), F.nullif(nz.domain_of(sender), F.lit("")).alias("sender_domain"), others.alias("recipient_addresses"), lower(F.col("ccs")).alias("cc_addresses"),
        "reply_to", F.col("bulk").alias("is_bulk"), F.col("headers").alias("raw_headers"), nz.body_text(F.col("plain"), F.col("html")).alias("body_text"), F.col("broken").alias("is_broken"),
    )


def backfill_days(spark: SparkSession, since: str, until: str, runs: DataFrame) -> DataFrame:
    """(day, status) of a backfill: done, failed (every run of the day failed), or open. runs: day, failed."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"))).alias("day"))
    by_day = runs.groupBy("day").agg(F.bool_and("failed").alias("bad"))
    return days.join(by_day, "day", "left").select("day", F.when(F.col("bad").isNull(), "open").when(F.col("bad"), "failed").otherwise("done").alias("status"))


def import_archive(archive: DataFrame, messages: DataFrame) -> DataFrame:
    """Message rows of the envelopes that have none yet: parsing is paid once, and a run that ends early goes on where it was."""
    return parse_messages(archive.join(messages.select("storage_key"), "storage_key", "left_anti"))


def rebuild(archive: DataFrame) -> dict[str, DataFrame]:
    """All that follows from the archive alone: messages, correspondents, and threads, derived anew."""
    mail = stage(parse_messages(archive))
    people = mail.filter("sender_address IS NOT NULL").groupBy("sender_address").agg(F.count(F.lit(1)).alias("n"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))
    threads = mail.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("direction") == "outbound").alias("sent"), F.max("sent_at").alias("last_at"))
    return {"messages": mail, "people": people, "threads": threads}


def backfill(messages: DataFrame, parsed: DataFrame, columns: list[str]) -> DataFrame:
    """Messages with missing values of some columns filled from a new parse of the same envelope."""
    new = parsed.select("storage_key", *[F.col(c).alias(f"_{c}") for c in columns])
    rows = messages.join(new, "storage_key", "left")
    return rows.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in messages.columns])


def _header(c: Column) -> Column:
    """Text that may stand in a header: no line ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "))


def render_pushed(rows: DataFrame, account: str) -> tuple[DataFrame, DataFrame]:
    """(envelopes, bad): messages of a chat network as mail with a synthetic address; direction decides From and To.

    rows: external_id, conversation_id, direction, partner_id, partner_name, text, sent_at.
    """
    fine = F.col("direction").isin("inbound", "outbound") & (F.trim(F.coalesce("external_id", F.lit(""))) != "") & (F.trim(F.coalesce("partner_id", F.lit(""))) != "")
    safe = F.regexp_replace(F.lower(F.trim("partner_id")), r"[^a-z0-9._-]+", "-")
    address = F.concat(safe, F.lit("@linkedin.invalid"))
    partner = F.concat(F.lit('"'), F.regexp_replace(_header(F.col("partner_name")), '["\\\\]', ""), F.lit('" <'), address, F.lit(">"))
    inbound = F.col("direction") == "inbound"
    date = F.date_format("sent_at", "EEE, dd MMM yyyy HH:mm:ss")
    lines = [F.concat(F.lit("From: "), F.when(inbound, partner).otherwise(F.lit(account))), F.concat(F.lit("To: "), F.when(inbound, F.lit(account)).otherwise(partner)), F.concat(F.lit("Date: "), date, F.lit(" +0000")), F.concat(F.lit("Message-ID: <"), _header(F.col("external_id")), F.lit("@linkedin.invalid>")), F.concat(F.lit("X-Conversation: "), _header(F.col("conversation_id")))]
    payload = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.coalesce("text", F.lit("")))
    good = rows.filter(F.coalesce(fine, F.lit(False)))
    meta = F.create_map(F.lit("occurred_at"), F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss"), F.lit("conversation_id"), F.col("conversation_id"))
    envelopes = good.select(F.lit("linkedin").alias("source"), "external_id", F.lit(account).alias("account"), F.col("sent_at").cast("timestamp").alias("fetched_at"), F.encode(payload, "utf-8").alias("payload"), meta.alias("metadata"))
    return envelopes, rows.filter(~F.coalesce(fine, F.lit(False)))


CONVERSATIONS = "elements array<struct<entityUrn:string,lastActivityAt:bigint,participants:array<struct<id:string,name:string>>,events:array<struct<entityUrn:string,createdAt:bigint,from:struct<id:string>,eventContent:struct<text:string>>>>>"


def conversation_messages(pages: DataFrame, self_id: str, since_ms: int = 0, column: str = "json") -> DataFrame:
    """(external_id, conversation_id, direction, partner_id, partner_name, text, sent_at) from nested conversation JSON.

    Conversations without activity after ``since_ms`` go, and so do older events and events that are no messages.
    """
    parsed = pages.select(F.explode(F.from_json(column, CONVERSATIONS)["elements"]).alias("c")).filter(F.col("c.lastActivityAt") > since_ms)
    others = F.filter("c.participants", lambda p: p["id"] != self_id)
    partner = F.coalesce(F.try_element_at(others, F.lit(1)), F.try_element_at("c.participants", F.lit(1)))
    events = parsed.select(F.col("c.entityUrn").alias("conversation_id"), partner.alias("partner"), F.explode("c.events").alias("e")).filter((F.col("e.createdAt") > since_ms) & F.col("e.eventContent.text").isNotNull())
    way = F.when(F.col("e.from.id") == self_id, "outbound").otherwise("inbound")
    return events.select(F.col("e.entityUrn").alias("external_id"), "conversation_id", way.alias("direction"), F.col("partner.id").alias("partner_id"), F.col("partner.name").alias("partner_name"), F.col("e.eventContent.text").alias("text"), F.timestamp_millis("e.createdAt").alias("sent_at"))


def run_log(runs: DataFrame, limit: int = 30) -> DataFrame:
    """The newest runs with their status. runs: id, started_at, finished_at, failed, row_errors."""
    errors = F.size(F.filter(F.split(F.coalesce("row_errors", F.lit("")), "\n"), lambda x: x != ""))
    status = F.when(F.col("failed"), "FAILED").when(F.col("finished_at").isNull(), "RUNNING").when(errors > 0, "ok, with row errors").otherwise("ok")
    return runs.select("*", status.alias("status"), errors.alias("errors")).orderBy(F.desc("started_at"), "id").limit(limit)


def ingest_health(runs: DataFrame) -> DataFrame:
    """One row: runs, failures, covered days, first and last day, days missing between. runs: day, failed."""
    ok = F.when(~F.col("failed"), F.col("day"))
    days = F.count_distinct(ok)
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if("failed").alias("failures"), days.alias("days"), F.min(ok).alias("first_day"), F.max(ok).alias("last_day"), (F.datediff(F.max(ok), F.min(ok)) + 1 - days).alias("missing"))


def read_only(spark: SparkSession, query: str, limit: int = 50) -> DataFrame:
    """An ad-hoc query over registered views; anything but a single SELECT or WITH is refused."""
    first = query.strip().split(None, 1)[0].upper() if query.strip() else ""
    if first not in ("SELECT", "WITH"):
        raise ValueError("only SELECT or WITH is allowed")
    return spark.sql(query).limit(limit)
