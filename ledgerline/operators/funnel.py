"""Funnel statistics: application facts, confirmed rounds, rates, hours, lags and counts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.schemas import BEYOND_SCREEN, GHOSTED_AFTER, IN_FLIGHT, INTERVIEWS, OUTCOMES, PREP_HOURS, PREP_MONTH, ROUND_HOURS, TERMINAL

from .scope import as_of, between, current_events, ghosted, in_window, latest, latest_stage


def derived_outcome(events: DataFrame) -> DataFrame:
    """(application_id, outcome_stage): the newest outcome among current events."""
    return latest(events.filter(F.col("stage").isin(*OUTCOMES)), "application_id", "occurred_at", "stage").select("application_id", F.col("stage").alias("outcome_stage"))


def application_facts(rec, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """One row an application: outcome, latest stage, last outbound time, last direction, had_offer.

    Claims of a derivation beat the outcome column, which speaks for applications that none has reached.
    An offer is an offer event, or an acceptance or refusal at a company that is no agency, with an interview
    stage or outbound mail behind it.
    """
    events = current_events(rec)
    # one pass over the events: a row without a time is newest of nothing
    newest = lambda which: F.max(F.when(F.col("occurred_at").isNotNull() & which, F.struct("occurred_at", "id", "stage")))["stage"]
    told = events.groupBy("application_id").agg(
        F.bool_or(F.col("stage") == "offer").alias("offered"), F.bool_or(F.col("stage").isin(*INTERVIEWS)).alias("interviewed"),
        newest(F.lit(True)).alias("latest_stage"), newest(F.col("stage").isin(*OUTCOMES)).alias("outcome_stage"),
    )
    mail = rec.message.groupBy("application_id").agg(
        F.max(F.when(F.col("direction") == "outbound", F.col("sent_at"))).alias("last_out"),
        F.max(F.struct("sent_at", "id", "direction"))["direction"].alias("last_dir"),
        F.bool_or(F.col("direction") == "outbound").alias("wrote"),
    )
    apps = in_window(rec.application, rec, since, until).withColumnRenamed("id", "application_id")
    joined = (
        apps.join(rec.company.select(F.col("id").alias("company_id"), "kind"), "company_id", "left")
        .join(told, "application_id", "left")
        .join(mail, "application_id", "left")
    )
    outcome = F.when(F.col("derived_at").isNotNull(), F.col("outcome_stage")).otherwise(F.coalesce("outcome", "outcome_stage"))
    implied = outcome.isin("accepted", "declined") & (F.coalesce("kind", F.lit("employer")) != "agency") & (F.coalesce("interviewed", F.lit(False)) | F.coalesce("wrote", F.lit(False)))
    return joined.select(
        "application_id", "company_id", outcome.alias("outcome"), "latest_stage", "last_out", "last_dir",
        (F.coalesce("offered", F.lit(False)) | F.coalesce(implied, F.lit(False))).alias("had_offer"),
    )


def confirmed_rounds(rec, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """(application_id, company_id, stage, d): interview rounds at their earliest evidence.

    A recruiter screen counts only with outbound mail to the company from 7 days before to 14 days after.
    That mail is reduced to the weeks it touches, so the join has two equal keys however much mail a company has.
    """
    rounds = current_events(rec).filter(F.col("stage").isin(*INTERVIEWS)).groupBy("application_id", "company_id", "stage").agg(F.min("occurred_at").alias("d"))
    rounds = in_window(rounds, rec, since, until, key="application_id")
    week = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (7 * 86_400_000_000))
    out = rec.message.filter((F.col("direction") == "outbound") & F.col("company_id").isNotNull()).select("company_id", F.col("sent_at").alias("sent"), week(F.col("sent_at")).alias("week")).distinct()
    screens = rounds.filter(F.col("stage") == "recruiter_screen").withColumn("week", F.explode(F.sequence(week(F.col("d")) - 1, week(F.col("d")) + 2)))
    near = (F.col("sent") >= F.col("d") - F.expr("INTERVAL 7 DAYS")) & (F.col("sent") <= F.col("d") + F.expr("INTERVAL 14 DAYS"))
    met = screens.join(out, ["company_id", "week"]).filter(near).select("application_id", "company_id", "stage", "d").distinct()
    return rounds.filter(F.col("stage") != "recruiter_screen").unionByName(met)


def round_hours(rec, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """(stage, rounds, interview_hours, prep_hours) of the confirmed rounds."""
    weight = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("stage")]
    counted = confirmed_rounds(rec, since, until).groupBy("stage").agg(F.count(F.lit(1)).alias("rounds"))
    return counted.select("stage", "rounds", (F.col("rounds") * weight(ROUND_HOURS)).alias("interview_hours"), (F.col("rounds") * weight(PREP_HOURS)).alias("prep_hours"))


def total_hours(rec, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """One row: rounds, active months, interview hours, and preparation with its monthly baseline."""
    rounds = confirmed_rounds(rec, since, until)
    weight = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("stage")]
    months = F.count_distinct(F.date_trunc("month", "d"))
    return rounds.agg(
        F.count(F.lit(1)).alias("rounds"), months.alias("months"), F.coalesce(F.sum(weight(ROUND_HOURS)), F.lit(0.0)).alias("interview_hours"),
        (F.coalesce(F.sum(weight(PREP_HOURS)), F.lit(0.0)) + months * PREP_MONTH).alias("prep_hours"),
    )


def engaged(rec, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """(application_id, company_id) with outbound mail to the company or a stage beyond the screen."""
    apps = in_window(rec.application, rec, since, until).select(F.col("id").alias("application_id"), "company_id")
    wrote = rec.message.filter("direction = 'outbound' AND company_id IS NOT NULL").select("company_id").distinct().withColumn("wrote", F.lit(True))
    went = current_events(rec).filter(F.col("stage").isin(*BEYOND_SCREEN)).select("application_id").distinct().withColumn("went", F.lit(True))
    return apps.join(wrote, "company_id", "left").join(went, "application_id", "left").filter("wrote OR went").select("application_id", "company_id")


def replied(rec, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """One row: companies with an application that were written to, and those that wrote after that."""
    with_app = rec.application.select("company_id").distinct()
    mail = rec.message.filter(between(F.col("sent_at"), since, until)).groupBy("company_id").agg(
        F.min(F.when(F.col("direction") == "outbound", F.col("sent_at"))).alias("first_out"), F.max(F.when(F.col("direction") == "inbound", F.col("sent_at"))).alias("last_in")
    )
    return mail.join(with_app, "company_id", "left_semi").agg(F.count("first_out").alias("reached_out"), F.count_if(F.col("last_in") > F.col("first_out")).alias("replied"))


def outcomes(rec, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """(outcome, applications); without an outcome an application is open."""
    return application_facts(rec, since, until).groupBy(F.coalesce("outcome", F.lit("open")).alias("outcome")).agg(F.count(F.lit(1)).alias("applications"))


def stats(rec, at: datetime | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """One row of funnel counts and rates."""
    at = as_of(rec, at)
    facts = application_facts(rec, since, until)
    active = engaged(rec, since, until).select("application_id", F.lit(True).alias("engaged"))
    rows = facts.join(active, "application_id", "left").withColumn("engaged", F.coalesce("engaged", F.lit(False)))
    rows = rows.withColumn("ghosted", ghosted(F.col("last_out"), F.col("last_dir"), F.col("latest_stage"), at, GHOSTED_AFTER))
    ended = F.coalesce(F.col("outcome").isin(*TERMINAL), F.lit(False)) | F.coalesce(F.col("latest_stage").isin(*TERMINAL), F.lit(False))
    live = ~ended & ~F.col("ghosted") & F.col("engaged")
    counted = rows.agg(
        F.count(F.lit(1)).alias("applications"), F.count_distinct("company_id").alias("companies"),
        F.count_distinct(F.when(F.col("engaged"), F.col("company_id"))).alias("engaged"),
        F.count_distinct(F.when(F.col("had_offer"), F.col("company_id"))).alias("offers"),
        F.count_if(F.col("outcome") == "rejected").alias("rejections"),
        F.count_if(live & (F.col("last_dir") == "inbound")).alias("court_yours"), F.count_if(live & (F.col("last_dir") == "outbound")).alias("court_theirs"),
        F.count_if(F.col("ghosted") & F.col("engaged")).alias("_ghosted"), F.count_if("engaged").alias("_engaged"),
    )
    interviewed = confirmed_rounds(rec, since, until).agg(F.count(F.lit(1)).alias("interviews"), F.count_distinct("company_id").alias("interviewed"))
    one = counted.withColumn("_one", F.lit(1)).join(replied(rec, since, until).withColumn("_one", F.lit(1)), "_one").join(interviewed.withColumn("_one", F.lit(1)), "_one")
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return one.select(
        "applications", "companies", "engaged", "offers", "rejections", "court_yours", "court_theirs", "interviews", "interviewed", "replied",
        rate("replied", "reached_out").alias("response_rate"), rate("_ghosted", "_engaged").alias("ghost_rate"),
    )


def momentum(rec, at: datetime | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """One row: confirmed rounds and outbound mail of the last 30 days and the 30 before; mail ignores the range."""
    at = as_of(rec, at)
    a30, a60 = F.lit(at - timedelta(days=30)), F.lit(at - timedelta(days=60))
    halves = lambda c, name: [F.count_if(c >= a30).alias(f"{name}_30d"), F.count_if((c >= a60) & (c < a30)).alias(f"{name}_prev_30d")]
    rounds = confirmed_rounds(rec, since, until).agg(*halves(F.col("d"), "rounds")).withColumn("_one", F.lit(1))
    mail = rec.message.filter("direction = 'outbound' AND company_id IS NOT NULL").agg(*halves(F.col("sent_at"), "outbound")).withColumn("_one", F.lit(1))
    return rounds.join(mail, "_one").drop("_one")


def _seconds(later, earlier):
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1e6


def reply_lag(rec, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """One row: median days from the first outbound message to the first inbound one after it, per application."""
    mail = rec.message.filter(between(F.col("sent_at"), since, until))
    first = mail.filter("direction = 'outbound'").groupBy("company_id").agg(F.min("sent_at").alias("first_out"))
    # one wait a company, then one row for each of its applications
    waits = mail.filter("direction = 'inbound'").join(first, "company_id").filter("sent_at > first_out").groupBy("company_id", "first_out").agg(F.min("sent_at").alias("first_in"))
    each = rec.application.select("company_id").join(waits, "company_id")
    return each.agg(F.percentile(_seconds("first_in", "first_out") / 86400, 0.5).alias("reply_lag_days"))


def weeks_to_offer(rec, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """One row: median weeks from a company's first message to its first offer."""
    offer = current_events(rec).filter("stage = 'offer'").filter(between(F.col("occurred_at"), since, until)).groupBy("company_id").agg(F.min("occurred_at").alias("offer_at"))
    start = rec.message.groupBy("company_id").agg(F.min("sent_at").alias("began"))
    return offer.join(start, "company_id").filter("began <= offer_at").agg(F.percentile(_seconds("offer_at", "began") / 604800, 0.5).alias("weeks_to_offer"))


def in_flight_count(rec) -> DataFrame:
    """One row: applications in mid-process; a screen counts only with outbound mail to the company."""
    apps = rec.application.filter("outcome IS NULL").select(F.col("id").alias("application_id"), "company_id")
    live = latest_stage(rec).filter(F.col("stage").isin(*IN_FLIGHT)).join(apps, "application_id")
    wrote = rec.message.filter("direction = 'outbound'").select("company_id").distinct().withColumn("wrote", F.lit(True))
    return live.join(wrote, "company_id", "left").filter("stage <> 'recruiter_screen' OR wrote").agg(F.count(F.lit(1)).alias("in_flight"))
