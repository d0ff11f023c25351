"""Queries of sources, streaming and expansion, with oracle SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import normalize as nz
from ledgerline.operators import expand
from ledgerline.sources import envelopes as env
from ledgerline.schemas import GHOSTED_AFTER, TERMINAL
from ledgerline.storage import shared_dir
from ledgerline.streaming import jobs, state

from .adapters import record
from .sql import over_record

QUERIES: dict = {}
ORACLES: dict = {}


def _mail(spark, sf_dir):
    """Conversations as envelopes of mail; every tenth turn is fetched twice."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " "))
    head = F.format_string(
        "From: %s\r\nTo: Me <me@own.example>, b%s@team.example\r\nCc: B%s@team.example\r\nSubject: Topic %s\r\nMessage-ID: <%s.%s@mail.example>\r\nDate: Mon, 02 Jan 2023 10:00:%s +0000\r\n%sContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n",
        F.when(F.col("role") == "user", F.lit("Me <ME@own.example>")).otherwise(F.concat(F.lit("A <a"), F.col("conv_id") % 9, F.lit("@Firm.example>"))),
        F.col("conv_id") % 5, F.col("conv_id") % 5, "conv_id", "conv_id", "turn", F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.when(F.col("turn") % 4 == 0, F.lit("List-Unsubscribe: <x>\r\n")).otherwise(F.lit("")),
    )
    rows = t.select(
        F.lit("mail").alias("source"), F.concat_ws(".", "conv_id", "turn").alias("external_id"), F.lit("me@own.example").alias("account"), F.lit("2023-01-03 00:00:00").cast("timestamp").alias("fetched_at"),
        F.encode(F.concat(head, F.col("text")), "utf-8").alias("payload"), F.when(F.col("turn") % 3 > 0, F.create_map(F.lit("occurred_at"), F.concat(F.lit("2023-01-02 10:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("metadata"), "turn",
    )
    twice = rows.filter("turn % 10 = 1").withColumn("fetched_at", F.col("fetched_at") + F.expr("INTERVAL 1 DAY"))
    return rows.unionByName(twice).drop("turn")


def raw_keys(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("files").alias("source"), F.col("source").alias("account"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("payload"), F.create_map(F.lit("occurred_at"), F.when(F.col("doc_id") % 4 > 0, F.format_string("2024-01-%02d 03:04:05", F.col("doc_id") % 28 + 1))).alias("metadata"))
    return env.with_keys(docs).select("doc_id", "content_hash", "storage_key")


QUERIES["raw_storage_keys"] = raw_keys
_FRAME = "unhex(lpad(printf('%x', octet_length({0})), 16, '0')) || {0}"
_HASH = "sha256(" + " || ".join(_FRAME.format(x) for x in ("encode('raw-v1')", "encode('files')", "encode(source)", "encode(coalesce(text, ''))")) + ")"
ORACLES["raw_storage_keys"] = f"""SELECT doc_id, h AS content_hash, 'raw/files/' || CASE WHEN doc_id % 4 > 0 THEN printf('2024/01/%02d/030405', doc_id % 28 + 1) ELSE 'unknown-date/unknown-date/unknown-date/000000' END || '_' || h || '.jsonl' AS storage_key
FROM (SELECT doc_id, {_HASH} AS h FROM documents)"""
QUERIES["write_once"] = lambda spark, sf_dir: env.write_once(None, env.with_keys(_mail(spark, sf_dir))).select("external_id")
ORACLES["write_once"] = "SELECT concat(conv_id, '.', turn) AS external_id FROM conversations"


def ingest_again(spark, sf_dir):
    new = env.with_keys(_mail(spark, sf_dir))
    held = env.write_once(None, new.filter("external_id LIKE '%.0'"))
    return env.ingest_counters(held, new, held)


QUERIES["ingest_counters"] = ingest_again
ORACLES["ingest_counters"] = """SELECT n + twice AS fetched, n - held AS stored, twice + held AS already_stored, n - held AS rows_inserted, held AS rows_existing
FROM (SELECT count(*) AS n, count(*) FILTER (turn % 10 = 1) AS twice, count(*) FILTER (CAST(turn AS VARCHAR) = '0') AS held FROM conversations)"""


def parsed_mail(spark, sf_dir):
    rows = env.parse_messages(env.write_once(None, env.with_keys(_mail(spark, sf_dir))))
    return rows.select("message_id_header", "direction", "subject", "sender_address", "sender_domain", F.array_join("recipient_addresses", ",").alias("recipients"), F.array_join("cc_addresses", ",").alias("cc"), "is_bulk", F.date_format("sent_at", "HH:mm:ss").alias("at"), F.md5(F.col("body_text").cast("binary")).alias("body"))


QUERIES["parse_messages"] = parsed_mail
ORACLES["parse_messages"] = r"""SELECT concat('<', conv_id, '.', turn, '@mail.example>') AS message_id_header, CASE WHEN role = 'user' THEN 'outbound' ELSE 'inbound' END AS direction, concat('Topic ', conv_id) AS subject,
  CASE WHEN role = 'user' THEN 'me@own.example' ELSE concat('a', conv_id % 9, '@firm.example') END AS sender_address, CASE WHEN role = 'user' THEN 'own.example' ELSE 'firm.example' END AS sender_domain,
  concat('b', conv_id % 5, '@team.example') AS recipients, concat('b', conv_id % 5, '@team.example') AS cc, turn % 4 = 0 AS is_bulk, concat('10:00:', lpad(CAST(turn % 60 AS VARCHAR), 2, '0')) AS at,
  md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g'), '[ \t]+', ' ', 'g'))) AS body FROM conversations"""


def pushed(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = t.select(F.concat_ws(".", "conv_id", "turn").alias("external_id"), F.col("conv_id").cast("string").alias("conversation_id"), F.when(F.col("role") == "user", "outbound").when(F.col("role") == "assistant", "inbound").otherwise("sideways").alias("direction"), F.concat(F.lit("urn:Li "), "conv_id").alias("partner_id"), F.lit('Ann "A" Lee').alias("partner_name"), "text", F.lit("2024-05-06 07:08:09").cast("timestamp").alias("sent_at"))
    good, bad = env.render_pushed(rows, "me@own.example")
    return good.select("external_id", F.md5("payload").alias("digest"), F.lit(True).alias("good")).unionByName(bad.select("external_id", F.lit(None).cast("string").alias("digest"), F.lit(False).alias("good")))


QUERIES["pushed_messages"] = pushed
_PARTNER = "concat('\"Ann A Lee\" <urn-li-', conv_id, '@linkedin.invalid>')"
ORACLES["pushed_messages"] = f"""SELECT concat(conv_id, '.', turn) AS external_id, CASE WHEN role IN ('user', 'assistant') THEN md5(concat('From: ', CASE WHEN role = 'assistant' THEN {_PARTNER} ELSE 'me@own.example' END, chr(13), chr(10),
  'To: ', CASE WHEN role = 'assistant' THEN 'me@own.example' ELSE {_PARTNER} END, chr(13), chr(10), 'Date: Mon, 06 May 2024 07:08:09 +0000', chr(13), chr(10), 'Message-ID: <', conv_id, '.', turn, '@linkedin.invalid>', chr(13), chr(10),
  'X-Conversation: ', conv_id, chr(13), chr(10), chr(13), chr(10), coalesce(text, ''))) END AS digest, role IN ('user', 'assistant') AS good FROM conversations"""


def nested(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    event = F.struct(F.concat_ws(".", "conv_id", "turn").alias("entityUrn"), (F.col("turn") * 1000 + F.col("conv_id") * 10000).alias("createdAt"), F.struct(F.when(F.col("role") == "user", F.lit("me")).otherwise(F.concat(F.lit("p"), "conv_id")).alias("id")).alias("from"), F.when(F.col("role") != "system", F.struct(F.col("text").alias("text"))).alias("eventContent"))
    one = t.groupBy("conv_id").agg(F.collect_list(event).alias("events"), F.max(F.col("turn") * 1000 + F.col("conv_id") * 10000).alias("last"))
    page = one.select(F.to_json(F.struct(F.array(F.struct(F.col("conv_id").cast("string").alias("entityUrn"), F.col("last").alias("lastActivityAt"), F.array(F.struct(F.lit("me").alias("id"), F.lit("Me").alias("name")), F.struct(F.concat(F.lit("p"), "conv_id").alias("id"), F.lit("Pat").alias("name"))).alias("participants"), "events")).alias("elements"))).alias("json"))
    return env.conversation_messages(page, "me", 300_000).select("external_id", "direction", "partner_id", F.unix_millis("sent_at").alias("ms"))


QUERIES["nested_conversations"] = nested
ORACLES["nested_conversations"] = "SELECT concat(conv_id, '.', turn) AS external_id, CASE WHEN role = 'user' THEN 'outbound' ELSE 'inbound' END AS direction, concat('p', conv_id) AS partner_id, turn * 1000 + conv_id * 10000 AS ms FROM conversations WHERE turn * 1000 + conv_id * 10000 > 300000 AND role <> 'system' AND text IS NOT NULL"


def _runs(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.to_date("ts").alias("day"), F.pmod("user_id", F.lit(3)).alias("id")).agg(F.max("ts").alias("started_at"), F.max("ts").alias("finished_at"), (F.sum("value") < 0).alias("failed"), F.lit("").alias("row_errors"), F.count(F.lit(1)).alias("n")).withColumn("failed", F.pmod("n", F.lit(2)) == 1)


_RUNS = "runs AS (SELECT CAST(ts AS DATE) AS day, ((user_id % 3) + 3) % 3 AS id, max(ts) AS started_at, count(*) % 2 = 1 AS failed FROM events GROUP BY 1, 2)"
QUERIES["ingest_health"] = lambda spark, sf_dir: env.ingest_health(_runs(spark, sf_dir))
ORACLES["ingest_health"] = f"WITH {_RUNS} SELECT count(*) AS runs, count(*) FILTER (failed) AS failures, count(DISTINCT day) FILTER (NOT failed) AS days, min(day) FILTER (NOT failed) AS first_day, max(day) FILTER (NOT failed) AS last_day, (max(day) FILTER (NOT failed) - min(day) FILTER (NOT failed)) + 1 - count(DISTINCT day) FILTER (NOT failed) AS missing FROM runs"
QUERIES["run_log"] = lambda spark, sf_dir: env.run_log(_runs(spark, sf_dir)).select("day", "id", "started_at", "status", "errors")
ORACLES["run_log"] = f"WITH {_RUNS} SELECT day, id, started_at, CASE WHEN failed THEN 'FAILED' ELSE 'ok' END AS status, 0 AS errors FROM runs ORDER BY started_at DESC, id LIMIT 30"
QUERIES["expand_seeds"] = lambda spark, sf_dir: (lambda r: expand.expand(r.message, r.message.filter("application_id % 500 = 7")))(record(spark, sf_dir))
_HOPS = "".join(f", k{h} AS MATERIALIZED (SELECT DISTINCT key FROM links WHERE id IN (SELECT id FROM h{h - 1})), h{h} AS MATERIALIZED (SELECT DISTINCT id FROM links WHERE key IN (SELECT key FROM k{h})" + "".join(f" AND id NOT IN (SELECT id FROM h{g})" for g in range(h)) + ")" for h in range(1, 5))
ORACLES["expand_seeds"] = over_record(f""", links AS MATERIALIZED (SELECT id, 't:' || thread_id AS key FROM message WHERE thread_id IN (SELECT thread_id FROM message WHERE direction = 'outbound') UNION ALL SELECT id, 'd:' || sender_domain FROM message),
h0 AS MATERIALIZED (SELECT DISTINCT id FROM message WHERE application_id % 500 = 7){_HOPS} """ + " UNION ALL ".join(f"SELECT id, {h} AS hop FROM h{h}" for h in range(5)))


def _events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def stream_counters(spark, sf_dir):
    work = shared_dir(spark)
    return jobs.drain(jobs.live_counters(_events(spark, sf_dir), "ts", "event_type", "1 day"), f"{work}/out", f"{work}/checkpoint").withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES["stream_counters"] = stream_counters
ORACLES["stream_counters"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2"


def stream_dedupe(spark, sf_dir):
    work = shared_dir(spark)
    return jobs.drain(jobs.dedupe(_events(spark, sf_dir).select("event_id", "ts", "user_id"), ["event_id"], "ts", "60 days"), f"{work}/out", f"{work}/checkpoint", "append").select("event_id", "user_id")


QUERIES["stream_dedupe"] = stream_dedupe
ORACLES["stream_dedupe"] = "SELECT event_id, any_value(user_id) AS user_id FROM events GROUP BY 1"


def mentions_of_events(events):
    return events.select(F.col("user_id").alias("company_id"), F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") != "view", F.concat_ws(" ", "event_type", F.col("event_id") % 3)).alias("role"), F.col("ts").cast("timestamp_ntz").alias("at"), (F.col("value") > 60).alias("ends"))


def _arriving(df, parts, part, start):
    """Each part of a table moved, whole, into the folder that a stream reads, which ``start`` begins anew and which then takes it as one batch, in however many files."""
    spark, work = df.sparkSession, shared_dir(df.sparkSession)
    df.withColumn("_part", F.pmod(part, F.lit(parts)).cast("int")).write.partitionBy("_part").parquet(f"{work}/waiting")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(work).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{work}/landing"))
    for k in range(parts):
        if files.exists(path(f"{work}/waiting/_part={k}")):  # else nothing arrived
            files.rename(path(f"{work}/waiting/_part={k}"), path(f"{work}/landing/{k}"))
            start(spark.readStream.schema(df.schema).parquet(f"{work}/landing/*")).awaitTermination()


def _said(df, parts, part, follow, schema):
    work = shared_dir(df.sparkSession)
    _arriving(df, parts, part, lambda stream: state.run_keyed(follow(stream), state.append_batches(f"{work}/said"), f"{work}/checkpoint"))
    return df.sparkSession.read.schema(f"{schema}, batch int").parquet(f"{work}/said")


def mentions_of_mail(r):
    roles = r.application.select(F.col("id").alias("application_id"), F.col("role_title").alias("role"))
    return r.message.join(roles, "application_id").select("company_id", "id", "role", F.col("sent_at").cast("timestamp_ntz").alias("at"), (F.col("direction") == "outbound").alias("ends"))


def stream_applications(spark, sf_dir):
    """Mentions that arrive in five batches, out of order; what the batch fold gives of the same table."""
    rows = mentions_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    said = _said(rows, 5, F.crc32("id"), state.follow_applications, state.FOLLOWED)
    return state.settled_applications(said)


def stream_applications_late(spark, sf_dir):
    """Mail that arrives year by year, some of it a year late, with a state that keeps sixty days of it; companies with later mail are folded anew."""
    rows = mentions_of_mail(record(spark, sf_dir))
    order = F.year("at") - 1995 + F.when(F.crc32("id") % 100 == 0, 1).otherwise(0)
    work = shared_dir(spark)
    _arriving(rows, 8, order, lambda stream: state.follow_in_batches(stream, f"{work}/folded", f"{work}/checkpoint", 60))
    return state.settled_applications(state.said_in_batches(spark, f"{work}/folded"), rows)


QUERIES["stream_applications"] = stream_applications
QUERIES["stream_applications_late"] = stream_applications_late


def stream_silences(spark, sf_dir):
    """Mail that arrives year by year; what silence made of applications, each state once, by timers."""
    r = record(spark, sf_dir)
    ends = r.stage_event.filter(F.col("stage").isin(*TERMINAL)).select(F.col("evidence_message_id").alias("id")).distinct().withColumn("ends", F.lit(True))
    rows = r.message.select("application_id", "id", F.col("sent_at").cast("timestamp").alias("sent_at"), "direction").join(ends, "id", "left").fillna(False, ["ends"])
    work = shared_dir(spark)
    _arriving(rows, 4, F.floor((F.year("sent_at") - 1995) / 2), lambda stream: state.silences_in_batches(stream, f"{work}/watched", f"{work}/checkpoint"))
    return state.silences_said(spark, f"{work}/watched").select("application_id", "state", F.col("since").cast("timestamp_ntz").alias("since"))


QUERIES["stream_silences"] = stream_silences
_TERMINAL_SQL = ", ".join(f"'{x}'" for x in TERMINAL)
ORACLES["stream_silences"] = over_record(f"""SELECT application_id, state, sent_at + days * INTERVAL 1 DAY AS since FROM (
  SELECT application_id, sent_at, direction, lead(sent_at) OVER w AS answer, bool_or(ends) OVER (w ROWS UNBOUNDED PRECEDING) AS ended, max(sent_at) OVER () AS clock
  FROM (SELECT m.*, EXISTS (SELECT 1 FROM stage_event e WHERE e.evidence_message_id = m.id AND e.stage IN ({_TERMINAL_SQL})) AS ends FROM message m) WINDOW w AS (PARTITION BY application_id ORDER BY sent_at, id)),
  (VALUES ('going_cold', {GHOSTED_AFTER - 7}), ('ghosted', {GHOSTED_AFTER})) s(state, days)
WHERE direction = 'outbound' AND NOT ended AND sent_at + days * INTERVAL 1 DAY < coalesce(answer, clock)""")


def _carry(batch, known):
    """Users of whom an earlier batch published something are known."""
    if known is None:
        return batch.withColumn("known", F.lit(False))
    return batch.join(known.select("user_id").distinct().withColumn("known", F.lit(True)), "user_id", "left").fillna(False, ["known"])


def stream_classification(spark, sf_dir):
    """Events that arrive in three parts, each classified by what the parts before it published."""
    work = shared_dir(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    for part in range(3):
        events.filter(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(f"{work}/landing")
        jobs.classify_stream(spark.readStream.schema(events.schema).parquet(f"{work}/landing"), _carry, f"{work}/store", f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/store").select("event_id", "known")


QUERIES["stream_classification"] = stream_classification
ORACLES["stream_classification"] = """SELECT event_id, event_id % 3 > min(event_id % 3) OVER (PARTITION BY user_id) AS known FROM events"""
QUERIES["stream_seen_ranges"] = lambda spark, sf_dir: (lambda work: jobs.drain(jobs.seen_ranges(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts"), f"{work}/out", f"{work}/checkpoint").select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "n"))(shared_dir(spark))
ORACLES["stream_seen_ranges"] = "SELECT user_id, min(ts)::TIMESTAMP AS first_at, max(ts)::TIMESTAMP AS last_at, count(*) AS n FROM events GROUP BY 1"


def stream_ingest(spark, sf_dir):
    """Envelope lines, landed as files, through the ingest stream twice; the second run adds nothing."""
    work = shared_dir(spark)
    env.to_lines(_mail(spark, sf_dir)).write.text(f"{work}/landing")
    for run in range(2):
        jobs.ingest_stream(spark, f"{work}/landing", f"{work}/store", f"{work}/checkpoint{run}").awaitTermination()
    return spark.read.parquet(f"{work}/store/archive").select("external_id")


QUERIES["stream_ingest"] = stream_ingest
ORACLES["stream_ingest"] = ORACLES["write_once"]
QUERIES["reply_subjects"] = lambda spark, sf_dir: record(spark, sf_dir).subject.select("id", nz.reply_subject(F.col("subject")).alias("reply"), nz.references_chain(F.when(F.col("idx") % 2 == 0, F.lit("<a> <b>")), F.lit("<c>"), F.col("id")).alias("chain"))
ORACLES["reply_subjects"] = over_record("SELECT id, CASE WHEN lower(subject) LIKE 're:%' THEN subject ELSE 'Re: ' || subject END AS reply, CASE WHEN idx % 2 = 0 THEN '<a> <b> ' ELSE '<c> ' END || id AS chain FROM subject")


def envelope_extras(spark, sf_dir):
    """Threading headers, folded ones too, and kept headers, long ones cut."""
    more = "Reply-To: R <r@x.example>\r\nIn-Reply-To: <p>\r\nReferences: <a>\r\n <b>\r\nX-Mailer: " + "m" * 600 + "\r\nX-Other: no\r\n"
    mail = _mail(spark, sf_dir).withColumn("payload", F.concat(F.encode(F.lit(more), "utf-8"), "payload"))
    rows = env.parse_messages(env.write_once(None, env.with_keys(mail)))
    kept = F.from_json("raw_headers", "map<string,string>")
    return rows.select(
        "message_id_header", "reply_to", "in_reply_to", F.array_join("references_ids", ",").alias("refs"), F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"),
        F.length(kept["X-Mailer"]).alias("mailer"), kept["List-Unsubscribe"].alias("unsubscribe"),
    )


QUERIES["envelope_extras"] = envelope_extras
ORACLES["envelope_extras"] = """SELECT concat('<', conv_id, '.', turn, '@mail.example>') AS message_id_header, 'R <r@x.example>' AS reply_to, '<p>' AS in_reply_to, '<a>,<b>' AS refs,
  CASE WHEN turn % 4 = 0 THEN 'List-Unsubscribe,X-Mailer' ELSE 'X-Mailer' END AS kept, 500 AS mailer, CASE WHEN turn % 4 = 0 THEN '<x>' END AS unsubscribe FROM conversations"""
