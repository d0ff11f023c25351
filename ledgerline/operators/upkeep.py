"""Upkeep of the record: secondary links, cursors, backlog slices, contacts, teaching with fan-out, verification, silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import normalize as nz
from ledgerline.schemas import GHOSTED_AFTER, OFFER_RANK, TERMINAL

from ledgerline.storage import stage

from . import mutate, rules
from .graphs import resolve_chains
from .scope import as_of, last_message, latest, latest_stage


def company_mail(messages: DataFrame, links: DataFrame) -> DataFrame:
    """(company_id, id): the mail of each company, its own and what secondary links (message_id, company_id) add, once each."""
    own = messages.filter("company_id IS NOT NULL").select("company_id", "id")
    return own.unionByName(links.select("company_id", F.col("message_id").alias("id"))).distinct()


def advance_cursors(cursors: DataFrame, batch: DataFrame) -> DataFrame:
    """Cursors (source, account, mark) after a batch (source, account, sent_at, failed): a mark moves forward only, and only if no row of its account failed."""
    keys = ["source", "account"]
    seen = batch.groupBy(*keys).agg(F.max("sent_at").alias("_at"), (~F.bool_or("failed")).alias("_fine"))
    moved = F.coalesce("_fine", F.lit(False)) & (F.col("mark").isNull() | (F.col("_at") > F.col("mark")))
    return cursors.join(seen, keys, "full").select(*keys, F.when(moved, F.col("_at")).otherwise(F.col("mark")).alias("mark"))


def backlog(messages: DataFrame, limit: int | None = None, k: int = 0, n: int = 1) -> DataFrame:
    """Unclassified mail, the oldest first; of slice k of n, which are disjoint and cover everything."""
    rows = messages.filter("classified_by IS NULL").filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k)
    return rows if limit is None else rows.orderBy("sent_at", "id").limit(limit)


def seed_pack(relays: list[str], systems: list[str], phrases: dict[str, list[str]], after=None) -> Column:
    """Names of the seed families that a message belongs to.

    Sent mail; mail of relays (addresses); mail from or to application systems (domains and those under them); phrase
    families outside noise labels. Columns: direction, addresses (sender first), subject, labels, sent_at.
    """
    domains = F.flatten(F.transform("addresses", lambda a: nz.suffixes(nz.domain_of(a))))
    low = F.lower(F.coalesce("subject", F.lit("")))
    quiet = ~F.coalesce(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in rules.NOISE_LABELS])), F.lit(False))
    any_of = lambda c, values: F.arrays_overlap(c, F.array(*[F.lit(v) for v in values]))
    named = [F.when(F.col("direction") == "outbound", "sent"), F.when(any_of(F.transform("addresses", F.lower), relays), "relay"), F.when(any_of(domains, systems), "system")]
    named += [F.when(quiet & F.exists(F.array(*[F.lit(p) for p in words]), lambda p: F.contains(low, p)), name) for name, words in phrases.items()]
    found = F.array_compact(F.array(*named))
    return found if after is None else F.when(F.col("sent_at") >= F.lit(after), found).otherwise(F.array().cast("array<string>"))


def residual(account: str) -> Column:
    """Mail addressed to the own account itself and without a noise label. Columns: addresses (sender first), labels."""
    mine = F.array_contains(F.transform(F.slice("addresses", 2, F.greatest(F.size("addresses"), F.lit(1))), F.lower), account.lower())
    return mine & ~F.coalesce(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in rules.NOISE_LABELS])), F.lit(False))


def fan_out(messages: DataFrame, new_rules: DataFrame, own_address: str = "") -> DataFrame:
    """Messages after new rules: backlog that a rule covers gets its company, or a negative mark; undecided rules change nothing.

    messages: id, addresses (sender first), company_id, classified_by.
    """
    open_ = messages.filter("classified_by IS NULL").select("id", "addresses")
    hits = rules.match_rules(open_, new_rules, own_address).filter("verdict IN ('positive', 'negative')").select("id", F.col("verdict").alias("_v"), F.col("company_id").alias("_c"))
    rows = messages.join(hits, "id", "left")
    company = F.when(F.col("_v") == "positive", F.col("_c")).when(F.col("_v").isNull(), F.col("company_id"))
    by = F.when(F.col("_v") == "positive", "rule:learned").when(F.col("_v") == "negative", "rule:negative").otherwise(F.col("classified_by"))
    return rows.withColumn("company_id", company).withColumn("classified_by", by).select(*messages.columns)


def learn_rules(known: DataFrame, messages: DataFrame, taught: DataFrame, own_address: str = "") -> tuple[DataFrame, DataFrame]:
    """(rules, messages) after a human taught rules: they replace what stood for the same key, and fan out over the backlog."""
    told = taught.select(*[F.lit("human").alias(c) if c == "source" else F.col(c) for c in known.columns])
    both = known.withColumn("_at", F.lit(0)).unionByName(told.withColumn("_at", F.lit(1)))
    return mutate.last_writer(both.filter("_at = 0"), both.filter("_at = 1"), ["match_type", "value"], "_at").drop("_at"), fan_out(messages, told, own_address)


def reply_context(messages: DataFrame) -> DataFrame:
    """Messages with company and application: their own, else those of the newest resolved mail of their thread, else of the mail that they answer.

    messages: id, thread_id, message_id_header, in_reply_to, company_id, application_id, sent_at.
    """
    carried = rules.carry_threads(messages)
    parents = messages.filter("company_id IS NOT NULL AND message_id_header IS NOT NULL").groupBy("message_id_header").agg(F.max_by(F.struct("company_id", "application_id"), F.struct("sent_at", "id")).alias("_p"))
    rows = carried.join(parents.withColumnRenamed("message_id_header", "in_reply_to"), "in_reply_to", "left")
    application = F.coalesce("application_id", F.when(F.col("company_id").isNull(), F.col("_p.application_id")))
    return rows.withColumn("application_id", application).withColumn("company_id", F.coalesce("company_id", "_p.company_id")).select(*messages.columns)


def merge_companies(companies: DataFrame, applications: DataFrame, messages: DataFrame, aliases: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All four tables after merging companies ``old`` into ``new``: mail and applications move, and so do aliases, with the old names."""
    names = companies.join(mapping, companies["id"] == mapping["old"]).select(F.col("new").alias("company_id"), F.explode(nz.alias_forms(F.col("canonical_name"), F.col("domain"))).alias("alias"))
    kept = companies.join(mapping.select(F.col("old").alias("id")), "id", "left_anti")
    carried = mutate.remap(aliases, "company_id", mapping).unionByName(names).distinct()
    return kept, mutate.remap(applications, "company_id", mapping), mutate.remap(messages, "company_id", mapping), carried


def apply_company_audit(tables: dict[str, DataFrame], plan: DataFrame) -> dict[str, DataFrame]:
    """The record after an audit of companies (id, action, target, name): merges, deletions and renames in one pass over seven tables.

    Merges are followed to their ends first; one that ends at a company that is deleted or unknown isn't made, and what is merged isn't
    deleted. Mail of deleted companies goes back to the backlog, their applications, events, aliases and links go, and
    rules lose their company. Old names of merged and renamed companies stay aliases.
    tables: companies, applications, events, messages, aliases (company_id, alias), links (message_id, company_id), rules.
    """
    companies = tables["companies"]
    asked = resolve_chains(plan.filter("action = 'merge' AND target IS NOT NULL").select(F.col("id").alias("old"), F.col("target").alias("new")))
    dead = plan.filter("action = 'delete'").select("id").join(asked.select(F.col("old").alias("id")), "id", "left_anti")
    stays = companies.select(F.col("id").alias("new")).join(dead.select(F.col("id").alias("new")), "new", "left_anti")
    mapping = stage(asked.join(stays, "new", "left_semi").join(companies.select(F.col("id").alias("old")), "old", "left_semi").select("old", "new"))
    # a deletion that gave way to a merge which isn't made after all is made
    gone = stage(plan.filter("action = 'delete'").select("id").distinct().join(mapping.select(F.col("old").alias("id")), "id", "left_anti"))
    gone_company = gone.select(F.col("id").alias("company_id"))
    names = plan.filter("action = 'rename'").groupBy("id").agg(F.min("name").alias("name")).withColumn("kind", F.lit(None).cast("string"))
    left, named = rename_companies(companies, tables["aliases"], names)
    kept, apps, mail, aliases = merge_companies(left, tables["applications"], tables["messages"], named, mapping)
    kept, apps, events, mail = mutate.delete_companies(kept, apps, tables["events"], mail, gone)
    links = mutate.remap(tables["links"], "company_id", mapping).join(gone_company, "company_id", "left_anti").select(*tables["links"].columns).distinct()
    rows = mutate.remap(tables["rules"], "company_id", mapping).join(gone_company.withColumn("_gone", F.lit(True)), "company_id", "left")
    cleared = rows.withColumn("company_id", F.when(F.col("_gone").isNull(), F.col("company_id"))).select(*tables["rules"].columns)
    return {"companies": kept, "applications": apps, "events": events, "messages": mail, "aliases": aliases.join(gone_company, "company_id", "left_anti").select(*tables["aliases"].columns), "links": links, "rules": cleared}


def apply_application_audit(applications: DataFrame, events: DataFrame, messages: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(applications, events, messages) after an audit (id, action, target): merges within a company, followed to their ends, then deletions.

    A merge that ends at an application of another company, or at one that is deleted, isn't made; what is merged isn't deleted. Deleted
    ones take their events with them, and their mail loses its application.
    """
    asked = resolve_chains(plan.filter("action = 'merge' AND target IS NOT NULL").select(F.col("id").alias("old"), F.col("target").alias("new")))
    dead = plan.filter("action = 'delete'").select("id").distinct()
    home = applications.select("id", "company_id")
    pairs = asked.join(home.select(F.col("id").alias("old"), F.col("company_id").alias("_a")), "old").join(home.select(F.col("id").alias("new"), F.col("company_id").alias("_b")), "new")
    mapping = pairs.filter("_a = _b").join(dead.join(asked.select(F.col("old").alias("id")), "id", "left_anti").select(F.col("id").alias("new")), "new", "left_anti").select("old", "new")
    mapping = stage(mapping)
    gone = stage(dead.join(mapping.select(F.col("old").alias("id")), "id", "left_anti"))
    apps, moved, mail = mutate.merge_applications(applications, events, messages, mapping)
    lost = gone.select(F.col("id").alias("application_id"), F.lit(True).alias("_gone"))
    rows = mail.join(lost, "application_id", "left").withColumn("application_id", F.when(F.col("_gone").isNull(), F.col("application_id"))).select(*messages.columns)
    return apps.join(gone, "id", "left_anti"), moved.join(lost.drop("_gone"), "application_id", "left_anti").select(*events.columns), rows


_TEACH = ["id", "at", "match_type", "value", "verdict", "company", "company_domain", "category", "kind"]


def teach_batch(taught: DataFrame, companies: DataFrame, aliases: DataFrame, known: DataFrame, cats: DataFrame, messages: DataFrame, own_address: str = "") -> dict[str, DataFrame]:
    """The record after a person taught rules (id, at, match_type, value, verdict, company, company_domain, category, kind), in order of time.

    A positive rule needs a company: that of the domain given (else the rule's own), else one that is called so, else a new one; what one
    teaching creates later ones find, so two of one new company make one. New companies are named after the teaching, ``new-`` before its id. A
    rule with a category becomes a member, and the category takes verdict and company; others carry them themselves. The last teaching of a key counts,
    and rules fan out over the backlog. Teachings about nothing to go by (positive, without name and domain) are left out.

    Of teachings with one domain and one name the first alone can create a company. Such firsts create one in a round if no earlier open one has their domain
    or would give a company their name; what shares a domain or name with it then is closed. Rounds follow the longest such chain, not the number of teachings,
    and at last each teaching meets what was known by its time. companies: id (text), canonical_name, domain, kind; aliases: company_id, alias.
    """
    low = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    rows = taught.select(*_TEACH).withColumn("_d", F.coalesce(low("company_domain"), F.when(F.col("match_type") == "domain", low("value")))).withColumn("_n", low("company"))
    rows = rows.withColumn("_at", F.struct("at", "id")).withColumn("_name", F.coalesce(F.trim("company"), "_d", "value")).withColumn("_m", F.lower("_name"))
    asks = stage(rows.filter("verdict = 'positive' AND (_n IS NOT NULL OR company_domain IS NOT NULL)").select("id", "_at", "_d", "_n", "_m", "_name", "kind"))
    domains = companies.filter("domain IS NOT NULL").groupBy(F.lower("domain").alias("_d")).agg(F.min("id").alias("_by_d"))
    called = aliases.groupBy(F.lower("alias").alias("_n")).agg(F.min("company_id").alias("_by_n"))
    alone = F.when(F.col("_d").isNull() & F.col("_n").isNull(), F.col("id"))  # nothing to find it by: each makes its own
    firsts = asks.groupBy("_d", "_n", "_m", alone.alias("_alone")).agg(F.min("_at").alias("_at"), F.min_by("_name", "_at").alias("_name"), F.min_by("kind", "_at").alias("kind"))
    open_ = stage(firsts.join(domains, "_d", "left_anti").join(called, "_n", "left_anti").drop("_alone"))
    made = None
    while open_.limit(1).count():
        first_d = open_.filter("_d IS NOT NULL").groupBy("_d").agg(F.min("_at").alias("_first_d"))
        first_m = open_.filter("_m IS NOT NULL").groupBy("_m").agg(F.min("_at").alias("_first_m"))
        met = open_.join(first_d, "_d", "left").join(first_m, "_m", "left")
        fresh = stage(met.filter("coalesce(_first_d = _at, true) AND coalesce(_first_m = _at, true)").select(*open_.columns))
        made = fresh if made is None else made.unionByName(fresh)
        left = open_.join(fresh.select("_at"), "_at", "left_anti").join(fresh.select("_d"), "_d", "left_anti")
        open_ = stage(left.join(fresh.select(F.col("_m").alias("_n")), "_n", "left_anti").select(*open_.columns))
    made = stage((open_ if made is None else made).withColumn("id", F.concat(F.lit("new-"), "_at.id")))
    by_domain = domains.withColumn("_since_d", F.lit(None).cast(made.schema["_at"].dataType)).unionByName(made.filter("_d IS NOT NULL").select("_d", F.col("id").alias("_by_d"), F.col("_at").alias("_since_d")))
    named = made.groupBy(F.col("_m").alias("_n")).agg(F.min_by("id", "_at").alias("_by_n"), F.min("_at").alias("_since_n")).join(called, "_n", "left_anti")
    by_name = called.withColumn("_since_n", F.lit(None).cast(made.schema["_at"].dataType)).unionByName(named)
    met = asks.join(by_domain, "_d", "left").join(by_name, "_n", "left")
    then = lambda by, since: F.when(F.coalesce(F.col(since) <= F.col("_at"), F.lit(True)), F.col(by))
    target = met.select("id", F.coalesce(then("_by_d", "_since_d"), then("_by_n", "_since_n"), F.concat(F.lit("new-"), "id")).alias("company_id"))
    all_companies = companies.unionByName(made.select("id", F.col("_name").alias("canonical_name"), F.col("_d").alias("domain"), F.coalesce("kind", F.lit("employer")).alias("kind")).select(*companies.columns))
    all_aliases = aliases.unionByName(made.select(F.col("id").alias("company_id"), F.col("_m").alias("alias"))).distinct()
    fine = rows.join(target, "id", "left").filter("verdict <> 'positive' OR company_id IS NOT NULL").filter(~F.lower(F.trim("value")).isin(*_own(own_address)))
    member = F.col("category").isNotNull()
    newest = fine.groupBy("match_type", F.lower(F.trim("value")).alias("value")).agg(F.max_by(F.struct("verdict", "company_id", "category"), "_at").alias("r"))
    told = newest.select("match_type", "value", F.when(F.col("r.category").isNull(), F.col("r.verdict")).alias("verdict"), "r.category", F.when(F.col("r.category").isNull(), F.col("r.company_id")).alias("company_id"), F.lit("human").alias("source"))
    rules_after = known.join(told.select("match_type", "value"), ["match_type", "value"], "left_anti").unionByName(told.select(*known.columns))
    groups = fine.filter(member).groupBy("category").agg(F.max_by(F.struct("verdict", "company_id"), "_at").alias("r")).select("category", "r.verdict", "r.company_id")
    cats_after = cats.join(groups.select("category"), "category", "left_anti").unionByName(groups.select(*cats.columns))
    return {"companies": all_companies, "aliases": all_aliases, "rules": rules_after, "categories": cats_after, "messages": fan_out(messages, rules.effective_rules(told, cats_after), own_address)}


def rename_companies(companies: DataFrame, aliases: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companies, aliases) after renames (id, name, kind): old and new names both stay aliases; a null leaves what is there."""
    held = renames.select("id", F.col("name").alias("_name"), F.col("kind").alias("_kind"))
    rows = companies.join(held, "id", "left")
    after = rows.withColumn("canonical_name", F.coalesce("_name", "canonical_name")).withColumn("kind", F.coalesce("_kind", "kind")).select(*companies.columns)
    touched = rows.filter("_name IS NOT NULL").select(F.col("id").alias("company_id"), "domain", F.explode(F.array("canonical_name", "_name")).alias("name"))
    more = touched.select("company_id", F.explode(nz.alias_forms(F.col("name"), F.col("domain"))).alias("alias"))
    return after, aliases.unionByName(more).distinct()


def _own(address: str) -> tuple[str, ...]:
    """The own address and its domain; a value that nothing equals where there is none."""
    low = address.strip().lower()
    return (low, low.rsplit("@", 1)[-1]) if "@" in low else (low or "@",)


def apply_verifications(companies: DataFrame, applications: DataFrame, events: DataFrame, messages: DataFrame, known: DataFrame, aliases: DataFrame, verdicts: DataFrame, own_address: str = "", links: DataFrame | None = None, model: str = "") -> dict[str, DataFrame]:
    """The record after verifications (company_id, negative, name, kind, rules): companies that don't matter go and their mail is marked;
    others take name and kind; suggested rules are added where none stands, but never for the own address or its domain, which all
    mail carries: such a rule would decide a whole mailbox.

    Of secondary links (message_id, company_id) those to companies that go go, and all of mail that was theirs. What was verified is itself a table,
    ``verifications``: a row for each verdict, with the rules it suggested, taken or not.
    """
    gone = verdicts.filter("negative").select(F.col("company_id").alias("id"))
    mail, _ = mutate.mark_negative(messages, messages.limit(0), gone)
    if links is None:
        links = messages.select(F.col("id").alias("message_id"), "company_id").limit(0)
    dead = messages.join(gone.select(F.col("id").alias("company_id")), "company_id", "left_semi").select(F.col("id").alias("message_id"))
    kept = links.join(gone.select(F.col("id").alias("company_id")), "company_id", "left_anti").join(dead, "message_id", "left_anti").select(*links.columns)
    audit = verdicts.select("company_id", F.lit(model).alias("model"), (~F.col("negative")).alias("correct"), F.col("name").alias("verified_name"), F.col("kind").alias("verified_kind"), F.col("rules").alias("suggested"))
    left, apps, stages, _ = mutate.delete_companies(companies, applications, events, messages.limit(0), gone)
    renamed, named = rename_companies(left, aliases.join(gone.select(F.col("id").alias("company_id")), "company_id", "left_anti"), verdicts.filter("NOT negative").select(F.col("company_id").alias("id"), "name", "kind"))
    told = verdicts.select("company_id", F.explode("rules").alias("r")).select("r.match_type", "r.value", "r.verdict", F.when(F.col("r.verdict") == "positive", F.col("company_id")).alias("company_id"))
    told = told.filter(~F.lower(F.trim("value")).isin(*_own(own_address)))
    new = told.select(*[F.lit("verification").alias(c) if c == "source" else F.col(c) if c in told.columns else F.lit(None).cast("string").alias(c) for c in known.columns])
    order = ["verdict", F.col("company_id").asc_nulls_last()]
    return {"companies": renamed, "applications": apps, "events": stages, "messages": mail, "aliases": named, "links": kept, "verifications": audit, "rules": mutate.insert_absent(known, new, ["match_type", "value"], order)}


def close_by_reason(queue: DataFrame, reason: str, status: str) -> DataFrame:
    """The queue with all pending items of one reason closed at once."""
    return queue.withColumn("status", F.when((F.col("status") == "pending") & (F.col("reason") == reason), status).otherwise(F.col("status")))


def resolve_contacts(contacts: DataFrame, links: DataFrame, mail: DataFrame, own_address: str = "") -> tuple[DataFrame, DataFrame]:
    """(contacts, links) after more mail: new addresses become contacts unless they are automated or the own one; links widen.

    contacts: contact_id, identifier; links: contact_id, company_id, first_at, last_at; mail: address, company_id, sent_at.
    """
    rows = mail.withColumn("identifier", F.lower(F.trim("address"))).filter(F.contains("identifier", F.lit("@")) & (F.col("identifier") != own_address.lower()) & nz.automated(F.col("identifier")).isNull())
    fresh = rows.select(F.md5(F.col("identifier").cast("binary")).alias("contact_id"), "identifier").distinct()
    known = mutate.insert_absent(contacts, fresh, ["identifier"])
    seen = rows.filter("company_id IS NOT NULL").join(known, "identifier").groupBy("contact_id", "company_id").agg(F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))
    return known, mutate.upsert(links, seen, ["contact_id", "company_id"], least=["first_at"], greatest=["last_at"])


def contact_details(mail: DataFrame) -> DataFrame:
    """(identifier, companies, messages, first_at, last_at, busiest): each person over all companies. mail: address, company_id, sent_at."""
    each = mail.groupBy(F.lower("address").alias("identifier"), "company_id").agg(F.count(F.lit(1)).alias("n"), F.min("sent_at").alias("f"), F.max("sent_at").alias("l"))
    busiest = F.max_by("company_id", F.struct("n", -F.col("company_id")))
    return each.groupBy("identifier").agg(F.count("company_id").alias("companies"), F.sum("n").alias("messages"), F.min("f").alias("first_at"), F.max("l").alias("last_at"), busiest.alias("busiest"))


def thread_readings(readings: DataFrame, messages: DataFrame, label: str | None = None) -> DataFrame:
    """Readings of threads (thread_id, label) with the newest message of each, and how many readings share the label."""
    newest = latest(messages, "thread_id", "sent_at", "id", "direction")
    counts = readings.groupBy("label").agg(F.count(F.lit(1)).alias("of_label"))
    rows = readings if label is None else readings.filter(F.col("label") == label)
    return rows.join(newest, "thread_id", "left").join(counts, "label", "left").select("thread_id", "label", "id", "direction", "sent_at", "of_label")


def triage_counts(queue: DataFrame) -> DataFrame:
    """(reason, status, n, oldest) of the review queue."""
    return queue.groupBy("reason", "status").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"))


def categories(known: DataFrame, cats: DataFrame) -> DataFrame:
    """Categories with the rules that name them; those that no rule names count 0."""
    n = known.filter("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("rules"), F.count_if(F.col("match_type") == "domain").alias("domains"))
    return cats.join(n, "category", "left").fillna(0, ["rules", "domains"])


def sender_coverage(mail: DataFrame, known: DataFrame) -> DataFrame:
    """One row: senders, those that a rule covers, and their mail. mail: id, address."""
    covered = rules.match_rules(mail.select("id", F.array("address").alias("addresses")), known).select("id", F.lit(1).alias("_hit"))
    rows = mail.join(covered, "id", "left")
    return rows.agg(F.count_distinct("address").alias("senders"), F.count_distinct(F.when(F.col("_hit") == 1, F.col("address"))).alias("covered"), F.count(F.lit(1)).alias("messages"), F.count("_hit").alias("covered_messages"))


def distilled(readings: DataFrame, candidates: DataFrame, known: DataFrame, own_address: str = "") -> DataFrame:
    """Rules after a distillation: readings (domain, verdict) of candidate domains, negative or undecided.

    No rule is made for a shared provider, the own domain, or services that all kinds of senders use. A negative verdict falls if any
    mail of the domain is linked to a company or was read as positive (candidates may have that count, ``positive``); a standing rule stays.
    """
    low = readings.withColumn("domain", F.lower(F.trim("domain")))
    fine = low.filter(F.col("verdict").isin("negative", "undecided") & ~nz.generic(F.col("domain")) & ~F.col("domain").isin(*nz.NEVER_RULED, *_own(own_address)))
    spoken = F.coalesce("positive", F.lit(0)) if "positive" in candidates.columns else F.lit(0)
    fine = fine.join(candidates.select(F.lower("sender_domain").alias("domain"), "linked", spoken.alias("spoken")), "domain")
    fine = fine.filter((F.col("verdict") != "negative") | ((F.col("linked") == 0) & (F.col("spoken") == 0)))
    new = fine.select(*[F.lit("domain").alias(c) if c == "match_type" else F.col("domain").alias(c) if c == "value" else F.col(c) if c == "verdict" else F.lit("distilled").alias(c) if c == "source" else F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns])
    return mutate.insert_absent(known, new, ["match_type", "value"], ["verdict"])


def learning_passes(mail: DataFrame, known: DataFrame, read: DataFrame, own_address: str = "") -> DataFrame:
    """(pass, calls, rules): how much a model must read before and after the rules that negative readings of the first pass teach.

    mail: id, address; read: id, sender_address, of the readings that came out negative.
    """
    taught = rules.teach_negative(read, known, own_address)
    # a rule covers all mail of an address or none
    senders = stage(mail.groupBy("address").agg(F.count(F.lit(1)).alias("n")))
    more = taught.select(*[F.lit("negative").alias(c) if c == "verdict" else F.lit("llm").alias(c) if c == "source" else F.col(c) if c in ("match_type", "value") else F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns])
    out = []
    for n, have in ((1, known), (2, known.unionByName(more))):
        covered = rules.match_rules(senders.select(F.col("address").alias("id"), F.array("address").alias("addresses")), have, own_address).select(F.col("id").alias("address"), F.lit(1).alias("_hit"))
        calls = senders.join(covered, "address", "left").agg(F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("n"))), F.lit(0)).alias("calls"))
        out.append(calls.crossJoin(have.agg(F.count(F.lit(1)).alias("rules"))).select(F.lit(n).alias("pass"), "calls", "rules"))
    return out[0].unionByName(out[1])


def accuracies(rows: DataFrame) -> DataFrame:
    """One row: shares of right stages and companies where the gold has one, and recall on automated mail. Columns: gold_stage, stage, gold_company, company, automated, kept."""
    share = lambda hit, of: F.coalesce(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(1.0))
    staged, named = F.col("gold_stage").isNotNull(), F.col("gold_company").isNotNull()
    return rows.agg(share(F.col("stage").eqNullSafe(F.col("gold_stage")), staged).alias("stage_accuracy"), share(F.col("company").eqNullSafe(F.col("gold_company")), named).alias("company_accuracy"), share(~F.col("kept"), F.col("automated")).alias("automated_recall"))


def silences(rec, at=None, cold_after: int = GHOSTED_AFTER - 7, ghosted_after: int = GHOSTED_AFTER) -> DataFrame:
    """(application_id, state, since): what silence has made of open applications by now: going cold, then ghosted, each from its own time on."""
    at = as_of(rec, at)
    rows = last_message(rec).filter("direction = 'outbound'").select("application_id", "sent_at").join(latest_stage(rec).select("application_id", "stage"), "application_id", "left")
    rows = rows.filter(F.col("stage").isNull() | ~F.col("stage").isin(*TERMINAL))
    step = lambda name, days: F.struct(F.lit(name).alias("state"), (F.col("sent_at") + F.make_dt_interval(F.lit(days))).alias("since"))
    both = rows.select("application_id", F.explode(F.array(step("going_cold", cold_after), step("ghosted", ghosted_after))).alias("s")).select("application_id", "s.state", "s.since")
    return both.filter(F.col("since") < F.lit(at))


def briefing_order(rows: DataFrame, by: str = "stage") -> DataFrame:
    """Rows of a briefing with their position: by company, stage (the furthest first), silence (the longest first) or touch (the newest first).

    Columns: application_id, canonical_name, stage, sent_at. Positions are counted over ranges of the order, in as many tasks as there are.
    """
    rank = F.coalesce(F.create_map(*[x for i, s in enumerate(OFFER_RANK) for x in (F.lit(s), F.lit(i))])[F.col("stage")], F.lit(-1))
    order = {"company": [F.lower("canonical_name")], "stage": [F.desc(rank)], "silence": [F.asc_nulls_last("sent_at")], "touch": [F.desc_nulls_last("sent_at")]}[by]
    return numbered(rows, [*order, F.col("application_id").asc()])


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """rows with their place, from 1, in a global order: dealt by ranges of it, and the counts of the ranges before are added. Ties beyond the order have no defined place."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(dealt).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).orderBy("_part").collect()  # a row for each task
    shifts, before = [], 0
    for r in counts:
        shifts.append((r["_part"], before - r["first"] + 1))
        before += r["n"]
    held = rows.sparkSession.createDataFrame(shifts, "_part long, _shift long")
    return placed.join(held, "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def carry_people(messages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, links) with company, application and contact, and the agency beside them, from the newest resolved mail of the thread where a message has no company.

    links: message_id, company_id, role; of a message's agencies the smallest is carried. messages: id, thread_id, sent_at, company_id, application_id, contact_id.
    """
    agency = links.filter("role = 'agency'").groupBy(F.col("message_id").alias("id")).agg(F.min("company_id").alias("_agency"))
    top = messages.filter("company_id IS NOT NULL AND thread_id IS NOT NULL").groupBy("thread_id").agg(F.max_by(F.struct("id", "company_id", "application_id", "contact_id"), F.struct("sent_at", "id")).alias("_top"))
    held = top.join(agency, F.col("_top.id") == F.col("id"), "left").select("thread_id", "_top", "_agency")
    rows = messages.join(held, "thread_id", "left").withColumn("_open", F.col("company_id").isNull() & F.col("_top").isNotNull())
    given = lambda c: F.when(F.col("_open"), F.col(f"_top.{c}")).otherwise(F.col(c)).alias(c)
    carried = rows.select(*[given(c) if c in ("company_id", "application_id", "contact_id") else F.col(c) for c in messages.columns])
    more = rows.filter("_open AND _agency IS NOT NULL").select(F.col("id").alias("message_id"), F.col("_agency").alias("company_id"), F.lit("agency").alias("role"))
    return carried, links.unionByName(more.select(*links.columns)).distinct()


def triage_negatives(rejected: DataFrame, known: DataFrame, own_address: str = "") -> DataFrame:
    """known with address rules for senders that triage rejected: a glance at a few words never rules out a domain, and senders that a rule covers are left alone.

    rejected: id, sender_address.
    """
    low = rejected.select("id", F.lower(F.trim("sender_address")).alias("address")).filter(F.contains("address", F.lit("@")) & (F.col("address") != own_address.lower()))
    covered = rules.match_rules(low.select("id", F.array("address").alias("addresses")), known).select("id")
    values = low.join(covered, "id", "left_anti").select("address").distinct()
    given = {"match_type": F.lit("address"), "value": F.col("address"), "verdict": F.lit("negative"), "source": F.lit("auto")}
    return known.unionByName(values.select(*[given.get(c, F.lit(None).cast(known.schema[c].dataType)).alias(c) for c in known.columns]))


def teach_from_misses(misses: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """known after an audit's misses (id, sender_address): addresses missed ``most`` times or more get a negative rule where none stands, and positive domain rules
    that the machine made and that linked missed mail become undecided: content is read again, nothing is silenced."""
    low = misses.select(F.lower(F.trim("sender_address")).alias("address")).filter(F.contains("address", F.lit("@")))
    often = low.groupBy("address").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most)
    domains = low.select(nz.domain_of(F.col("address")).alias("_d")).distinct().withColumn("_missed", F.lit(True))
    rows = known.withColumn("_d", F.lower("value")).join(domains, "_d", "left")
    doubtful = F.col("_missed").isNotNull() & (F.col("match_type") == "domain") & (F.col("verdict") == "positive") & (F.col("source") == "auto")
    held = rows.withColumn("verdict", F.when(F.coalesce(doubtful, F.lit(False)), "undecided").otherwise(F.col("verdict"))).select(*known.columns)
    given = {"match_type": F.lit("address"), "value": F.col("address"), "verdict": F.lit("negative"), "source": F.lit("audit")}
    new = often.select(*[given.get(c, F.lit(None).cast(known.schema[c].dataType)).alias(c) for c in known.columns])
    return mutate.insert_absent(held, new, ["match_type", "value"], ["verdict"])
