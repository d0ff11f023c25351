"""Constraint checks, rebuild equality and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import normalize as nz
from ledgerline.schemas import STAGES


def violations(rec) -> DataFrame:
    """(rule, key) for every row of the record that breaks a constraint."""
    def bad(rule: str, rows: DataFrame, broken: Column, key: str = "id") -> DataFrame:
        return rows.filter(broken).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))

    def twice(rule: str, rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"))

    found = [
        bad("company.name", rec.company, F.trim("canonical_name") == ""),
        bad("company.kind", rec.company, ~F.col("kind").isin("employer", "agency")),
        bad("stage_event.stage", rec.stage_event, ~F.col("stage").isin(*STAGES)),
        bad("stage_event.evidence", rec.stage_event, F.col("evidence_message_id").isNull()),
        twice("message.id", rec.message, "id"),
        twice("stage_event.evidence_once", rec.stage_event.filter("evidence_message_id IS NOT NULL"), "application_id", "stage", "evidence_message_id"),
        twice("review_queue.one_pending", rec.review_queue.filter("status = 'pending'"), "message_id"),
        rec.stage_event.join(rec.application.select(F.col("id").alias("application_id"), "started_at"), "application_id").filter("occurred_at < started_at").select(F.lit("stage_event.before_start").alias("rule"), F.col("id").alias("key")),
        twice("company.domain", rec.company.filter("domain IS NOT NULL"), "domain"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one of two derivations has and the other lacks, with repeats; none if they are equal."""
    counted = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1))).groupBy(*left.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))
    return counted.withColumn("side", F.when(F.col("_n") > 0, "left").otherwise("right")).withColumn("_n", times).drop("_n")


def scorecard(rows: DataFrame, predicted: str = "predicted", gold: str = "gold", resolved: str | None = None) -> DataFrame:
    """One row: precision, recall, F1, resolution rate and noise accuracy; without cases a rate is 0, noise accuracy 1."""
    p, g = F.col(predicted), F.col(gold)
    counts = rows.agg(
        F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(resolved) if resolved else F.lit(True)).alias("resolved"),
    )
    rate = lambda a, b, none: F.when(b > 0, a / b).otherwise(F.lit(none))
    c = F.col
    precision, recall = rate(c("tp"), c("tp") + c("fp"), 0.0), rate(c("tp"), c("tp") + c("fn"), 0.0)
    return counts.select("tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), rate(2 * precision * recall, precision + recall, 0.0).alias("f1"), rate(c("resolved"), c("n"), 0.0).alias("resolution_rate"), rate(c("tn"), c("tn") + c("fp"), 1.0).alias("noise_accuracy"))


def retrieval_scorecard(flagged: DataFrame, families: list[str], gold: str) -> DataFrame:
    """(layer, fetched, share, recall, precision) of query families taken one after the other; flags are boolean columns."""
    shown = []
    so_far = F.lit(False)
    for k, family in enumerate(families):
        so_far = so_far | F.coalesce(F.col(family), F.lit(False))
        shown.append(F.struct(F.lit(k).alias("layer"), F.lit(family).alias("family"), so_far.alias("hit")))
    each = flagged.select(F.coalesce(F.col(gold), F.lit(False)).alias("gold"), F.explode(F.array(*shown)).alias("s")).select("gold", "s.*")
    counts = each.groupBy("layer", "family").agg(F.count_if("hit").alias("fetched"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit") & F.col("gold")).alias("found"), F.count_if("gold").alias("wanted"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.select("layer", "family", "fetched", rate("fetched", "n").alias("share"), rate("found", "wanted").alias("recall"), rate("found", "fetched").alias("precision"))


def same_company(one: Column, other: Column) -> Column:
    """Whether two names mean one company: of their letters and digits one begins with the other; without a name nothing matches."""
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    a, b = flat(one), flat(other)
    return (a != "") & (b != "") & (a.startswith(b) | b.startswith(a))


def classification_scorecard(rows: DataFrame) -> DataFrame:
    """One row: how predictions do against gold, pooled over all mail.

    Precision, recall and F1 of what isn't called negative; the share that is resolved either way; right stages and companies of job mail (null where there is
    none of a stage); recall on automated senders; noise that was dropped; and the webmail guard: job mail from a shared provider's address whose company isn't the provider. A part without
    mail scores 1, and its count says so. rows: label, stage, company, sender_address, gold_related, gold_stage, gold_company.
    """
    called, related = F.coalesce(F.col("label") != "negative", F.lit(True)), F.col("gold_related")
    domain = nz.domain_of(F.lower("sender_address"))
    automated = related & nz.automated(F.lower("sender_address")).isNotNull()
    webmail = related & nz.generic(domain)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = rows.agg(
        n(called & related).alias("tp"), n(called & ~related).alias("fp"), n(~called & related).alias("fn"), F.count(F.lit(1)).alias("n"), n(F.col("label").isin("positive", "negative")).alias("resolved"), n(related).alias("jobs"),
        n(related & F.col("stage").eqNullSafe(F.col("gold_stage"))).alias("stages"), n(related & same_company(F.col("company"), F.col("gold_company"))).alias("companies"), n(automated).alias("automated_n"), n(automated & called).alias("kept"),
        n(~related).alias("noise_n"), n(~related & ~called).alias("dropped"), n(webmail).alias("webmail_n"), n(webmail & ~same_company(F.col("company"), F.substring_index(domain, ".", 1))).alias("guarded"),
    )
    share = lambda hit, of, none: F.when(F.col(of) > 0, F.col(hit) / F.col(of)).otherwise(F.lit(none))
    precision, recall = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return counts.select(
        precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"), share("resolved", "n", 0.0).alias("resolution_rate"),
        share("stages", "jobs", 0.0).alias("stage_accuracy"), share("companies", "jobs", 0.0).alias("company_accuracy"), share("kept", "automated_n", 1.0).alias("automated_recall"), "automated_n",
        share("dropped", "noise_n", 1.0).alias("noise_accuracy"), "noise_n", share("guarded", "webmail_n", 1.0).alias("webmail_guard"), "webmail_n",
    )
