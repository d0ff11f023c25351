"""The batch classifier with readings as tables: coercion, planning, application, sweep, triage, gates and audits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import normalize as nz
from ledgerline.schemas import STAGES

from .stages import accepted_index, forward_order

LABELS = ("positive", "negative", "ambiguous", "unclassified")
READING = "label string, company_name string, company_domain string, company_kind string, role_title string, stage string, contact_name string, contact_email string, occurred_at string"
_RULE = "array<struct<match_type:string,value:string,verdict:string,reason:string>>"


def coerce(readings: DataFrame, raw: str = "raw") -> DataFrame:
    """Readings with typed columns and ``ok``: an object, or an array of one, is taken; any other shape is an error row.

    Unknown stages and kinds become null, unknown labels unclassified, and text that says nothing null.
    """
    text = F.trim(raw)
    one = F.from_json(text, READING)
    many = F.from_json(text, f"array<struct<{', '.join(c.replace(' ', ':') for c in READING.split(', ')).replace(', ', ',')}>>")
    is_array = text.startswith("[")
    e = F.when(is_array & (F.size(many) == 1), many[0]).when(text.startswith("{"), one)
    whole = F.coalesce(F.when(is_array, F.size(many) == 1).otherwise(text.startswith("{") & F.try_parse_json(text).isNotNull()), F.lit(False))
    rows = readings.withColumn("_e", e)
    stage, label = F.lower(F.trim("_e.stage")), F.col("_e.label")
    return rows.select(
        *[c for c in readings.columns if c != raw], whole.alias("ok"), F.when(whole, F.when(label.isin(*LABELS), label).otherwise("unclassified")).alias("label"),
        nz.clean(F.col("_e.company_name")).alias("company_name"), nz.clean(F.col("_e.company_domain"), lower=True).alias("company_domain"),
        F.when(F.col("_e.company_kind").isin("employer", "agency"), F.col("_e.company_kind")).alias("company_kind"), nz.clean(F.col("_e.role_title")).alias("role_title"),
        F.when(stage.isin(*STAGES), stage).alias("stage"), nz.clean(F.col("_e.contact_email"), lower=True).alias("contact_email"), F.try_to_timestamp("_e.occurred_at").alias("occurred_at"),
    )


def coerce_rules(raw: Column) -> Column:
    """Suggested rules of a verification: valid ones alone, values in lower case."""
    parsed = F.coalesce(F.from_json(raw, _RULE), F.array().cast(_RULE))
    fine = F.filter(parsed, lambda r: r["match_type"].isin("domain", "address") & r["verdict"].isin("positive", "negative", "undecided") & (F.trim(r["value"]) != ""))
    return F.transform(fine, lambda r: F.struct(r["match_type"].alias("match_type"), F.lower(F.trim(r["value"])).alias("value"), r["verdict"].alias("verdict"), r["reason"].alias("reason")))


def plan_calls(messages: DataFrame, verdicts: DataFrame, carried: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, thread_id, tier): what a model must read: the backlog without what rules, threads and fresh readings decide.

    One message stands for a thread, the newest; wording of an ending goes to the strong tier.
    messages: id, thread_id, sent_at, subject, text; verdicts: id, status, explored; carried, fresh: thread_id.
    """
    open_ = messages.join(verdicts.filter("status = 'negative' AND NOT explored").select("id"), "id", "left_anti")
    open_ = open_.join(carried.select("thread_id"), "thread_id", "left_anti").join(fresh.select("thread_id"), "thread_id", "left_anti")
    tier = F.when(nz.looks_terminal(F.col("subject"), F.col("text")), "strong").otherwise("cheap")
    own = F.coalesce("thread_id", F.concat(F.lit("#"), "id"))
    rows = open_.withColumn("_t", own).withColumn("tier", tier)
    return rows.groupBy("_t").agg(F.max_by(F.struct("id", "thread_id"), F.struct("sent_at", "id")).alias("m"), F.max("tier").alias("tier")).select("m.id", "m.thread_id", "tier")


def route(readings: DataFrame) -> DataFrame:
    """Readings with ``branch`` and ``reason``: mark negative, record, or queue for review."""
    named = nz.names_a_company(F.col("company_name"), F.col("company_domain"))
    branch = F.when(F.col("label") == "negative", "negative").when((F.col("label") == "positive") & named, "record").otherwise("queue")
    reason = F.when(branch != "queue", None).when(F.col("label") == "positive", "job-related but no company identified").otherwise("unclassified")
    return readings.withColumn("branch", branch).withColumn("reason", reason)


def sweep(pending: DataFrame, gates: list[tuple[str, DataFrame]]) -> DataFrame:
    """Pending reviews with ``outcome`` and company from the first gate that decides; else they stay.

    gates, in order: name and a table (message_id, company_id); a null company closes the item as not job-related.
    """
    rows = pending
    for name, gate in gates:
        rows = rows.join(gate.select("message_id", F.struct(F.lit(name).alias("outcome"), F.col("company_id")).alias(f"_{name}")), "message_id", "left")
    first = F.coalesce(*[F.col(f"_{name}") for name, _ in gates])
    return rows.withColumn("_g", first).select(*pending.columns, F.coalesce("_g.outcome", F.lit("stays")).alias("outcome"), F.col("_g.company_id").alias("company_id"))


def triage(messages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The messages that go on to a full reading; without a verdict a message is kept. verdicts: id, job_related."""
    return messages.join(verdicts.select("id", "job_related"), "id", "left").filter(F.coalesce("job_related", F.lit(True))).drop("job_related")


def triage_savings(messages: DataFrame, verdicts: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: readings avoided, noise recall, and false negatives. gold: id, job_related."""
    v, g = verdicts.select("id", F.col("job_related").alias("v")), gold.select("id", F.col("job_related").alias("g"))
    rows = messages.select("id").join(v, "id", "left").join(g, "id").withColumn("kept", F.coalesce("v", F.lit(True)))
    noise = F.count_if(~F.col("g"))
    return rows.agg(F.count_if(~F.col("kept")).alias("avoided"), F.when(noise > 0, F.count_if(~F.col("kept") & ~F.col("g")) / noise).otherwise(1.0).alias("noise_recall"), F.count_if(~F.col("kept") & F.col("g")).alias("missed"))


def derivation_gates(claims: DataFrame, chain: DataFrame, company: str) -> DataFrame:
    """Claims that their evidence supports, in forward order.

    claims: application_id, idx, stage; chain: application_id, idx, id, subject, sender, direction, occurred_at. A claim
    whose index isn't in its chain goes, and so do offers and answers whose subjects don't evidence them; a welcome must
    name the employer. An acceptance without any stage before it goes too.
    """
    rows = claims.join(chain, ["application_id", "idx"]).filter(nz.is_evidence(F.col("stage"), F.col("subject"), F.col("sender"), F.col("direction")))
    rows = rows.filter((F.col("stage") != "accepted") | nz.welcome_names(F.col("subject"), F.lit(company)))
    before = F.count_if(~F.col("stage").isin("accepted", "declined", "rejected", "withdrawn")).over(Window.partitionBy("application_id"))
    rows = rows.withColumn("_funnel", before).filter((F.col("stage") != "accepted") | (F.col("_funnel") > 0)).drop("_funnel")
    return forward_order(rows.select("id", "application_id", "stage", "occurred_at"))


def onboarding_claims(claims: DataFrame, chain: DataFrame, company: str) -> DataFrame:
    """Claims with the acceptance that onboarding mail proves, where an application claims none; in forward order.

    What is added is named after its message, ``hire-`` before it, and comes after claims of the same time.
    claims: id, application_id, stage, occurred_at; chain: application_id, idx, id, subject, occurred_at.
    """
    proof = chain.join(accepted_index(chain), ["application_id", "idx"]).filter(nz.welcome_names(F.col("subject"), F.lit(company)))
    added = proof.join(claims.filter("stage = 'accepted'").select("application_id"), "application_id", "left_anti")
    return forward_order(claims.select("id", "application_id", "stage", "occurred_at").unionByName(added.select(F.concat(F.lit("hire-"), "id").alias("id"), "application_id", F.lit("accepted").alias("stage"), "occurred_at")))


def audit_applications(applications: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, action, target) for companies of more than one application: merge into another one of the same company, or delete.

    applications: id, company_id; verdicts: id, verdict (merge, delete or keep), target. Merges into what is itself merged
    or deleted are left out, so a plan can be applied in any order.
    """
    many = applications.groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = applications.join(many, "company_id").select("id", "company_id").join(verdicts.filter("verdict IN ('merge', 'delete')").select("id", "verdict", "target"), "id")
    stays = applications.join(rows.select("id"), "id", "left_anti").select(F.col("id").alias("target"), F.col("company_id").alias("_c"))
    merged = rows.filter("verdict = 'merge'").join(stays, "target").filter(F.col("company_id") == F.col("_c")).select("id", F.lit("merge").alias("action"), "target")
    return merged.unionByName(rows.filter("verdict = 'delete'").select("id", F.lit("delete").alias("action"), F.lit(None).cast(applications.schema["id"].dataType).alias("target")))


def audit_companies(companies: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, action, target, name): junk and newsletters are deleted, persons and misnamed ones renamed, duplicates merged.

    companies: id, canonical_name; verdicts: id, verdict, target, name. A rename needs a new name, a merge a company that stays.
    """
    rows = companies.select("id", "canonical_name").join(verdicts.select("id", "verdict", "target", "name"), "id")
    named = F.trim(F.coalesce("name", F.lit(""))) != ""
    action = F.when(F.col("verdict").isin("junk", "newsletter"), "delete").when(F.col("verdict").isin("person", "misnamed") & named & (F.trim("name") != F.coalesce("canonical_name", F.lit(""))), "rename").when(F.col("verdict") == "duplicate", "merge")
    plan = rows.withColumn("action", action).filter("action IS NOT NULL")
    gone = plan.filter("action <> 'rename'").select("id")
    stays = companies.select(F.col("id").alias("target")).join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    fine = plan.filter("action <> 'merge'").unionByName(plan.filter("action = 'merge'").join(stays, "target", "left_semi"))
    return fine.select("id", "action", F.when(F.col("action") == "merge", F.col("target")).alias("target"), F.when(F.col("action") == "rename", F.trim("name")).alias("name"))


def read(messages: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Readings that a user's function gives of batches of messages, for ``coerce`` and ``route``; it is called in the tasks."""
    return messages.mapInPandas(lambda batches: (fn(pdf) for pdf in batches), schema)


def audit_plan(messages: DataFrame, cheap: DataFrame, strong: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, action, target): unlink where both tiers say so; relink where they agree on a target that evidence confirms.

    cheap and strong: id, belongs, target; evidence: id, evidence (of the target).
    """
    a = cheap.select("id", F.col("belongs").alias("a_ok"), F.col("target").alias("a_to"))
    b = strong.select("id", F.col("belongs").alias("b_ok"), F.col("target").alias("b_to"))
    rows = messages.select("id").join(a, "id").join(b, "id").join(evidence.select("id", "evidence"), "id", "left")
    moved = ~F.col("a_ok") & ~F.col("b_ok")
    relink = moved & (F.col("a_to") == F.col("b_to")) & F.col("evidence").isNotNull()
    action = F.when(F.coalesce(relink, F.lit(False)), "relink").when(moved, "unlink")
    return rows.select("id", action.alias("action"), F.when(action == "relink", F.col("a_to")).alias("target")).filter("action IS NOT NULL")


def demotions(misses: DataFrame, rules: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(demoted, taught): negative rules that exploration contradicted, unless a human made them, and addresses missed ``most`` times or more.

    misses: kind (explored or missed), match_type, value.
    """
    explored = misses.filter("kind = 'explored'").select("match_type", "value").distinct()
    demoted = rules.filter("verdict = 'negative' AND source <> 'human'").join(explored, ["match_type", "value"], "left_semi").withColumn("verdict", F.lit("undecided"))
    taught = misses.filter("kind = 'missed' AND match_type = 'address'").groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most).select(F.lit("address").alias("match_type"), "value", F.lit("negative").alias("verdict"))
    return demoted, taught
