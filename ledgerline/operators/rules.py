"""Sender rules: matching by domain suffix, verdicts, exploration, teaching and fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import normalize as nz
from ledgerline.storage import few, stage

NOISE_LABELS = ("CATEGORY_PROMOTIONS", "CATEGORY_SOCIAL", "CATEGORY_FORUMS")


def effective_rules(rules: DataFrame, categories: DataFrame, category_first: bool = True) -> DataFrame:
    """Rules with verdict and company from their category where they have one.

    The classifier lets the category speak first, the listing the rule: category_first chooses.
    """
    cats = categories.select("category", F.col("verdict").alias("_v"), F.col("company_id").alias("_c"))
    rows = rules.join(cats, "category", "left")
    pick = (lambda own, cat: F.coalesce(cat, own)) if category_first else (lambda own, cat: F.coalesce(own, cat))
    return rows.select("match_type", "value", pick(F.col("verdict"), F.col("_v")).alias("verdict"), "category", pick(F.col("company_id"), F.col("_c")).alias("company_id"), "source")


def match_rules(messages: DataFrame, rules: DataFrame, own_address: str = "") -> DataFrame:
    """(id, verdict, company_id, category, matched): the rule that covers a message, if any.

    messages: id, addresses (sender first). Addresses and all parents of their domains meet rules by equality, each
    address once and not once a message; an address rule beats domain rules, an earlier address a later one, a longer
    suffix a shorter one. The own address is no correspondent.
    """
    each = messages.select("id", F.posexplode("addresses").alias("pos", "address")).withColumn("address", F.lower(F.trim("address"))).filter(F.col("address") != own_address.lower())
    known = rules.select("match_type", F.lower("value").alias("value"), "verdict", "company_id", "category").groupBy("match_type", "value").agg(F.min(F.struct("verdict", "company_id", "category")).alias("rule"))
    found = stage(_of_addresses(each.select("address").distinct(), known).withColumn("n", F.monotonically_increasing_id()))
    # kind, position and depth in one number, the best the least, and of the address a number: a plain aggregate of longs finds the rule
    code = F.shiftleft(F.col("kind").cast("long"), 40) + F.shiftleft(F.col("pos").cast("long"), 8) + F.col("depth")
    best = each.join(few(found.select("address", "kind", "depth", "n")), "address").groupBy("id").agg(F.min_by("n", code).alias("n"))
    return best.join(few(found), "n").select("id", "rule.verdict", "rule.company_id", "rule.category", "match_type", F.col("value").alias("matched"))


def _of_addresses(names: DataFrame, known: DataFrame) -> DataFrame:
    """(address, kind, depth, match_type, value, rule): the rule that covers an address, its own before those of its domain's suffixes, the longest of these first."""
    parents = names.select("address", F.posexplode(nz.suffixes(nz.domain_of(F.col("address")))).alias("depth", "value"))
    tries = names.select("address", F.lit(0).alias("kind"), F.lit(0).alias("depth"), F.lit("address").alias("match_type"), F.col("address").alias("value")).unionByName(
        parents.select("address", F.lit(1).alias("kind"), "depth", F.lit("domain").alias("match_type"), "value")
    )
    met = tries.join(known, ["match_type", "value"])
    return met.groupBy("address").agg(F.min(F.struct("kind", "depth", "match_type", "value", "rule")).alias("r")).select("address", "r.*")


def verdict(learned: Column, known_contact: Column, thread_positive: Column, labels: Column, bulk: Column) -> Column:
    """Struct of status and reasons, from metadata alone; a bulk header is told but decides nothing."""
    noise = F.array_sort(F.array_intersect(labels, F.array(*[F.lit(x) for x in NOISE_LABELS])))
    noisy = F.coalesce(F.size(noise) > 0, F.lit(False))
    status = F.when(F.coalesce(learned == "positive", F.lit(False)) | known_contact | thread_positive, "positive").when(learned == "undecided", "undecided").when(F.coalesce(learned == "negative", F.lit(False)) | noisy, "negative").otherwise("undecided")
    reasons = F.array_compact(F.array(
        F.when(known_contact, "known-contact"), F.when(thread_positive, "thread-positive"), F.concat(F.lit("learned:"), learned),
        F.when(noisy, F.concat(F.lit("label:"), F.array_join(noise, "|"))), F.when(bulk, "bulk-header"),
    ))
    return F.struct(status.alias("status"), reasons.alias("reasons"))


def fanout(messages: DataFrame, match_type: str, value: str) -> DataFrame:
    """One row: what a new rule would decide, in the backlog and among messages that are classified already."""
    hit = F.col("sender_domain") == value if match_type == "domain_exact" else F.array_contains(nz.suffixes(F.col("sender_domain")), value)
    return messages.filter(hit).agg(F.count_if(F.col("classified_by").isNull()).alias("backlog"), F.count_if(F.col("classified_by").isNotNull()).alias("classified"))


def thread_context(messages: DataFrame) -> DataFrame:
    """(thread_id, company_id, application_id) of the newest resolved message of each thread."""
    found = messages.filter("company_id IS NOT NULL AND thread_id IS NOT NULL").groupBy("thread_id").agg(F.max_by(F.struct("company_id", "application_id"), F.struct("sent_at", "id")).alias("r"))
    return found.select("thread_id", "r.*")


def carry_threads(messages: DataFrame) -> DataFrame:
    """Messages with company and application, from their thread where they have none."""
    held = thread_context(messages).select("thread_id", F.col("company_id").alias("_c"), F.col("application_id").alias("_a"))
    return messages.join(held, "thread_id", "left").withColumn("application_id", F.coalesce("application_id", F.when(F.col("company_id").isNull(), F.col("_a")))).withColumn("company_id", F.coalesce("company_id", "_c")).drop("_c", "_a")


def domain_carry(messages: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, company_id): for mail without a company, the company with the longest domain equal to or above the sender's; bulk mail (is_bulk) is left out."""
    own = messages.filter("company_id IS NULL")
    parents = (own.filter(~F.coalesce("is_bulk", F.lit(False))) if "is_bulk" in own.columns else own).select("id", F.explode(nz.suffixes(F.col("sender_domain"))).alias("domain"))
    known = companies.filter("domain IS NOT NULL").select(F.lower("domain").alias("domain"), F.col("id").alias("company_id"))
    return parents.join(known, "domain").groupBy("id").agg(F.max_by("company_id", F.struct(F.length("domain"), -F.col("company_id"))).alias("company_id"))


def unresolved_correspondents(messages: DataFrame, limit: int = 50) -> DataFrame:
    """(kind, value, n, subject): backlog by domain, or by address where the domain is a shared provider's.

    messages: id, sender_address, sender_domain, subject, sent_at, of the backlog.
    """
    kind = F.when(nz.generic(F.col("sender_domain")), "address").otherwise("domain")
    rows = messages.withColumn("kind", kind).withColumn("value", F.when(F.col("kind") == "address", F.col("sender_address")).otherwise(F.col("sender_domain")))
    grouped = rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max_by("subject", F.struct("sent_at", "id")).alias("subject"))
    return grouped.orderBy(F.desc("n"), "kind", "value").limit(limit)


def review_ranking(reviews: DataFrame, messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pending reviews by how many unresolved messages share their sender's domain, doubled for undecided domains.

    Siblings are counted once a domain instead of once a row.
    """
    waiting = messages.filter("company_id IS NULL OR classified_by IS NULL").groupBy("sender_domain").agg(F.count(F.lit(1)).alias("siblings"))
    open_rules = rules.filter("match_type = 'domain' AND verdict = 'undecided'").select(F.col("value").alias("sender_domain")).distinct().withColumn("open", F.lit(True))
    newest = reviews.filter("status = 'pending'").groupBy("message_id").agg(F.max_by(F.struct("id", "reason", "created_at"), F.struct("created_at", "id")).alias("q")).select("message_id", "q.*")
    rows = newest.join(messages.select(F.col("id").alias("message_id"), "sender_domain"), "message_id").join(waiting, "sender_domain", "left").join(open_rules, "sender_domain", "left")
    impact = F.coalesce("siblings", F.lit(0)) * F.when(F.col("open"), 2).otherwise(1)
    return rows.select("id", "message_id", "reason", "sender_domain", impact.alias("impact"), "created_at").orderBy(F.desc("impact"), F.desc("created_at"), "id")


def teach_positive(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """(domain, company_id, verdict) that confident positives teach, in order of time.

    A domain's first company pins it as undecided; a later reading for the same company promotes it. Agencies and
    shared providers teach nothing, nor do domains with a standing rule that isn't an undecided one pinned to a
    company by no human. readings: id, domain, company_id, kind, at.
    """
    fine = readings.filter(F.col("domain").isNotNull() & ~nz.generic(F.lower("domain")) & ~F.col("kind").eqNullSafe(F.lit("agency")))
    standing = rules.filter("match_type = 'domain'").groupBy(F.lower("value").alias("domain")).agg(F.min(F.struct("verdict", "company_id", "source")).alias("rule"))
    # a row of a domain and company, however much mail they have: the first of them all, and whether its company comes again
    pairs = fine.withColumn("domain", F.lower("domain")).groupBy("domain", "company_id").agg(F.min(F.struct("at", "id")).alias("since"), F.count(F.lit(1)).alias("n"))
    by = pairs.join(standing, "domain", "left").groupBy("domain").agg(F.first("rule").alias("rule"), F.min_by(F.struct("company_id", "n"), "since").alias("f"), F.bool_or(F.col("company_id") == F.col("rule.company_id")).alias("agrees"))
    by = by.select("domain", "rule", F.col("f.company_id").alias("first"), (F.col("f.company_id").isNotNull() & (F.col("f.n") > 1)).alias("again"), "agrees")
    new = by.filter("rule IS NULL").select("domain", F.col("first").alias("company_id"), F.when(F.col("again"), "positive").otherwise("undecided").alias("verdict"))
    raised = by.filter("rule.verdict = 'undecided' AND rule.source <> 'human' AND agrees").select("domain", F.col("rule.company_id").alias("company_id"), F.lit("positive").alias("verdict"))
    return new.unionByName(raised)


def teach_negative(readings: DataFrame, rules: DataFrame, own_address: str = "") -> DataFrame:
    """(match_type, value) that negatives teach: a domain, or an address at a shared or the own domain; nothing that a rule covers."""
    own = own_address.lower()
    # what is taught is told by the address alone, so each is looked at once
    rows = stage(readings.select("sender_address").distinct()).select(F.lower(F.regexp_replace(F.trim("sender_address"), "^[<>]+|[<>]+$", "")).alias("address")).distinct().filter(F.contains("address", F.lit("@")) & (F.col("address") != own))
    rows = rows.select(F.col("address").alias("id"), "address", nz.domain_of(F.col("address")).alias("domain")).filter("domain <> ''")
    covered = match_rules(rows.select("id", F.array("address").alias("addresses")), rules).select("id")
    narrow = nz.generic(F.col("domain")) | (F.col("domain") == F.lit(own.split("@")[-1] if own else None))
    free = rows.join(covered, "id", "left_anti")
    return free.select(F.when(F.coalesce(narrow, F.lit(False)), "address").otherwise("domain").alias("match_type"), F.when(F.coalesce(narrow, F.lit(False)), F.col("address")).otherwise(F.col("domain")).alias("value")).distinct()


def distillation_candidates(messages: DataFrame, rules: DataFrame, own_domain: str = "") -> DataFrame:
    """(sender_domain, messages, linked, senders, threads): domains judged by a model and covered by no domain rule."""
    judged = messages.filter("classified_by LIKE 'model%'").groupBy("sender_domain").agg(
        F.count(F.lit(1)).alias("messages"), F.count("company_id").alias("linked"), F.count_distinct("company_id").alias("companies"), F.count_distinct("thread_id").alias("threads")
    )
    ruled = rules.filter("match_type = 'domain'").select(F.lower("value").alias("sender_domain"))
    return judged.filter((F.col("sender_domain") != own_domain) & ~nz.generic(F.col("sender_domain"))).join(ruled, "sender_domain", "left_anti")


def domain_dossiers(messages: DataFrame, readings: DataFrame, queued: DataFrame, rules: DataFrame, own_domain: str = "", most: int = 400) -> DataFrame:
    """What is known of each domain that was ever judged and that no domain rule covers, for distilling a rule.

    (domain, messages, linked, bulk, senders, negative, positive, unclassified, relationships, kinds, reasoning). Judged is mail that a
    model or an audit classified, that was queued, or whose thread was read; a reading speaks for its whole thread.
    messages: id, thread_id, sender_domain, sender_address, company_id, is_bulk, classified_by; readings: thread_id, label,
    relationship, company_kind, reasoning; queued: message_id.
    """
    mail = messages.filter("sender_domain <> ''").withColumn("domain", F.lower("sender_domain")).filter(~F.col("domain").isin(*nz.NEVER_RULED) & (F.col("domain") != own_domain.lower()))
    mail = mail.join(rules.filter("match_type = 'domain'").select(F.lower("value").alias("domain")), "domain", "left_anti")
    asked = queued.select(F.col("message_id").alias("id")).distinct().withColumn("_q", F.lit(True))
    read = readings.select("thread_id").distinct().withColumn("_r", F.lit(True))
    by_model = F.coalesce(F.col("classified_by").like("model%") | F.col("classified_by").like("audit:%"), F.lit(False))
    judged = mail.join(asked, "id", "left").join(read, "thread_id", "left").filter(by_model | F.col("_q").isNotNull() | F.col("_r").isNotNull())
    counted = judged.groupBy("domain").agg(F.count(F.lit(1)).alias("messages"), F.count("company_id").alias("linked"), F.count_if("is_bulk").alias("bulk"), F.count_distinct("sender_address").alias("senders"))
    told = readings.join(mail.select("thread_id", "domain").distinct(), "thread_id")
    threads = lambda label: F.count_distinct(F.when(F.col("label") == label, F.col("thread_id"))).alias(label)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    labels = told.groupBy("domain").agg(*[threads(x) for x in ("negative", "positive", "unclassified")])
    # relationships and kinds are small vocabularies; of reasons only as many as the text can hold are gathered
    kinds = told.groupBy("domain").agg(listed("relationship").alias("relationships"), listed("company_kind").alias("kinds"))
    reasons = told.filter("reasoning <> ''").select("domain", "reasoning").distinct().withColumn("_k", F.row_number().over(Window.partitionBy("domain").orderBy("reasoning"))).filter(F.col("_k") <= most // 4 + 1)
    reasons = reasons.groupBy("domain").agg(F.substring(F.array_join(F.array_sort(F.collect_list(F.substring("reasoning", 1, most))), " | "), 1, most).alias("reasoning"))
    return counted.join(labels, "domain", "left").join(kinds, "domain", "left").join(reasons, "domain", "left").fillna(0, ["negative", "positive", "unclassified"])
