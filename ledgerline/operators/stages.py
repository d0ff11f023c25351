"""Ordered folds over stage events: runs, windows, forward order, generations, acceptance, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import normalize as nz
from ledgerline.schemas import PROGRESS, TERMINAL


def _by(key: str, tie: str = "id") -> Window:
    return Window.partitionBy(key).orderBy("occurred_at", tie)


def collapse_runs(events: DataFrame, key: str = "application_id") -> DataFrame:
    """The earliest of consecutive events of one stage."""
    return events.withColumn("_before", F.lag("stage").over(_by(key))).filter(~F.col("_before").eqNullSafe(F.col("stage"))).drop("_before")


def _progress(stage: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv])[stage]


def resolve_windows(events: DataFrame, key: str = "application_id", hours: float = 24.0) -> DataFrame:
    """Within some hours of a window's first event the furthest stage wins, dated to that first event.

    A window is anchored at its first event, so it is a fold over an application's events in order, which are few;
    terminal events close the window before them and pass as they are. Of equally far stages the earliest wins.
    """
    fields = F.struct(F.col("occurred_at"), F.col("id"), F.col("stage"))
    ordered = events.groupBy(key).agg(F.array_sort(F.collect_list(fields)).alias("_log"))
    none = F.lit(None)
    kind = "struct<at:timestamp_ntz,id:string,stage:string>"
    event_type = events.schema["occurred_at"].dataType.simpleString()
    kind = kind.replace("timestamp_ntz", event_type)
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), none.cast(kind).alias("best"), none.cast(event_type).alias("began"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6

    def shown(held):
        return F.when(held["best"].isNotNull(), F.concat(held["out"], F.array(F.struct(held["began"].alias("at"), held["best"]["id"].alias("id"), held["best"]["stage"].alias("stage"))))).otherwise(held["out"])

    def step(held, e):
        this = F.struct(e["occurred_at"].alias("at"), e["id"].alias("id"), e["stage"].alias("stage"))
        fresh = held["best"].isNull() | (seconds(e["occurred_at"]) - seconds(held["began"]) > hours * 3600)
        ahead = _progress(e["stage"]) > _progress(held["best"]["stage"])
        end = F.struct(F.concat(shown(held), F.array(this)).alias("out"), none.cast(kind).alias("best"), none.cast(event_type).alias("began"))
        new = F.struct(shown(held).alias("out"), this.alias("best"), e["occurred_at"].alias("began"))
        same = F.struct(held["out"].alias("out"), F.when(ahead, this).otherwise(held["best"]).alias("best"), held["began"].alias("began"))
        return F.when(e["stage"].isin(*TERMINAL), end).when(fresh, new).otherwise(same)

    done = ordered.select(key, F.explode(F.aggregate("_log", start, step, shown)).alias("e"))
    return done.select(F.col("e.id").alias("id"), key, F.col("e.stage").alias("stage"), F.col("e.at").alias("occurred_at"))


def forward_order(events: DataFrame, key: str = "application_id") -> DataFrame:
    """Only events that move a process forward: nothing but endings after an ending, no stage twice or below the highest."""
    before = _by(key).rowsBetween(Window.unboundedPreceding, -1)
    ending = F.col("stage").isin(*TERMINAL)
    rows = events.withColumn("_ended", F.coalesce(F.max(ending).over(before), F.lit(False)))
    # a dropped event never raises the highest rank: it is not above it, or comes after an ending
    rank = F.when(~ending, _progress(F.col("stage")))
    rows = rows.withColumn("_high", F.coalesce(F.max(rank).over(before), F.lit(-1)))
    return rows.filter(ending | (~F.col("_ended") & (rank > F.col("_high")))).drop("_ended", "_high")


def latest_batch(events: DataFrame, key: str = "application_id") -> DataFrame:
    """The events of each application's newest generation; unstamped ones are the oldest."""
    newest = events.groupBy(key).agg(F.max("derived_at").alias("_newest"))
    return events.join(newest, key).filter(F.col("derived_at").eqNullSafe(F.col("_newest"))).drop("_newest")


def terminal_outcome(applications: DataFrame, claims: DataFrame) -> DataFrame:
    """(application_id, outcome): the last terminal claim; none if there are claims without one; else the column."""
    last = claims.groupBy("application_id").agg(F.max_by(F.when(F.col("stage").isin(*TERMINAL), F.col("stage")), F.when(F.col("stage").isin(*TERMINAL), F.struct("occurred_at", "id"))).alias("_claimed"), F.count(F.lit(1)).alias("_n"))
    return applications.select(F.col("id").alias("application_id"), "outcome").join(last, "application_id", "left").select("application_id", F.when(F.col("_n") > 0, F.col("_claimed")).otherwise(F.col("outcome")).alias("outcome"))


def accepted_index(subjects: DataFrame, key: str = "application_id", position: str = "idx", subject: str = "subject") -> DataFrame:
    """(key, idx) of the first subject that proves an acceptance.

    Plain onboarding words do; words from either side of a hire do with corroboration in the subject or before it.
    """
    like = lambda p: F.coalesce(F.regexp_like(F.col(subject), F.lit(p)), F.lit(False))
    so_far = F.max(like(nz.CORROBORATION)).over(Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    proof = ~like(nz.NOT_ONBOARDING) & (like(nz.ONBOARDING) | (like(nz.AMBIGUOUS) & F.col("_so_far")))
    return subjects.withColumn("_so_far", so_far).filter(proof).groupBy(key).agg(F.min(position).alias("idx"))


def timeline(events: DataFrame) -> DataFrame:
    """Claims as a company page shows them: runs collapsed, windows resolved, runs collapsed again."""
    return collapse_runs(resolve_windows(collapse_runs(events.select("id", "application_id", "stage", "occurred_at"))))


def close_applications(applications: DataFrame, claims: DataFrame) -> DataFrame:
    """Applications with ended_at: the first terminal claim at or after the start, where none is set."""
    first = claims.filter(F.col("stage").isin(*TERMINAL)).groupBy(F.col("application_id").alias("id")).agg(F.min_by(F.struct("occurred_at", "stage"), F.struct("occurred_at", "stage")).alias("_end"))
    rows = applications.join(first, "id", "left")
    return rows.withColumn("ended_at", F.when(F.col("_end.occurred_at") >= F.col("started_at"), F.col("_end.occurred_at"))).drop("_end")


def stage_conflicts(events: DataFrame, key: str = "application_id") -> DataFrame:
    """Non-terminal events at or after the first ending before them: what a close guard refuses."""
    ended = F.min(F.when(F.col("stage").isin(*TERMINAL), F.col("occurred_at"))).over(_by(key).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_ended", ended).filter(~F.col("stage").isin(*TERMINAL) & (F.col("occurred_at") >= F.col("_ended"))).drop("_ended")


def conversation_application(conversations: DataFrame, applications: DataFrame) -> DataFrame:
    """(conversation_id, application_id): the company's application whose span holds the time, else the nearest end.

    applications: id, company_id, started_at, last_at.
    """
    apps = applications.select(F.col("id").alias("application_id"), "company_id", "started_at", "last_at")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    outside = ~((F.col("occurred_at") >= F.col("started_at")) & (F.col("occurred_at") <= F.col("last_at")))
    pairs = conversations.join(apps, "company_id")
    return pairs.groupBy("conversation_id").agg(F.min_by("application_id", F.struct(outside, F.abs(micros("occurred_at") - micros("last_at")), F.col("application_id"))).alias("application_id"))
