"""Seed queries and their expansion over senders, domains and threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import normalize as nz
from ledgerline.storage import stage

from .upkeep import residual


def phrase_family(text: Column, phrases: list[str], labels: Column | None = None, noise: tuple[str, ...] = ()) -> Column:
    """Any of some phrases, outside the mail that carries a noise label."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))
    if labels is None or not noise:
        return hit
    return hit & ~F.coalesce(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in noise])), F.lit(False))


def expand(messages: DataFrame, seeds: DataFrame, hops: int = 4) -> DataFrame:
    """(id, hop): messages reached from seeds through shared sender domains and threads, within some hops.

    Domains of shared providers lead nowhere, and so do threads without own outbound mail. Hops go from threads to domains and back, in tables that
    have a row for each; messages are in buckets by thread, and get their hop at the end, from their thread or their domain.
    messages: id, thread_id, sender_domain, direction; rows of one id agree in them.
    """
    start = stage(seeds.select("id").distinct())
    domain = F.when(~nz.generic(F.col("sender_domain")), F.col("sender_domain"))
    rows = messages.select("id", "thread_id", domain.alias("domain"), F.coalesce(F.col("direction") == "outbound", F.lit(False)).alias("sent"))
    rows = rows.join(start.withColumn("seed", F.lit(True)), "id", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    rows = stage(rows.repartition("thread_id"), by="thread_id")
    answered = F.max("sent").over(Window.partitionBy("thread_id"))
    pairs = rows.filter("thread_id IS NOT NULL").groupBy("thread_id", "domain").agg(F.max("sent").alias("sent"), F.max("seed").alias("seed"))
    pairs = stage(pairs.withColumn("own", answered).filter("own").select("thread_id", "domain", "seed").repartition("thread_id"), by="thread_id")
    threads = stage(pairs.filter("seed").select("thread_id").distinct().withColumn("by_thread", F.lit(1)))
    domains = stage(rows.filter("seed AND domain IS NOT NULL").select("domain").distinct().withColumn("by_domain", F.lit(1)))
    for hop in range(2, hops + 1):
        met = lambda df, c: df.filter(F.col(c) == hop - 1)  # noqa: B023, E731
        further = pairs.filter("domain IS NOT NULL").join(met(threads, "by_thread"), "thread_id", "left_semi").select("domain").distinct()
        more = pairs.join(met(domains, "by_domain"), "domain", "left_semi").select("thread_id").distinct()
        further = stage(further.join(domains, "domain", "left_anti").withColumn("by_domain", F.lit(hop)))
        more = stage(more.join(threads, "thread_id", "left_anti").withColumn("by_thread", F.lit(hop)))
        if not further.limit(1).count() and not more.limit(1).count():
            break
        domains, threads = domains.unionByName(further), threads.unionByName(more)
    found = rows.filter("NOT seed").join(threads, "thread_id", "left").join(domains, "domain", "left").select("id", F.least("by_thread", "by_domain").alias("hop"))
    return start.withColumn("hop", F.lit(0)).unionByName(found.filter(F.col("hop") <= hops).groupBy("id").agg(F.min("hop").alias("hop")))


#: Kinds of what a frontier holds, in the order in which a message is put down to them.
KINDS = {"d": "domain", "a": "address", "t": "thread"}


def expand_record(messages: DataFrame, seeds: DataFrame, own_address: str = "", hops: int = 4) -> DataFrame:
    """(id, hop, via): mail found by seeds, then through domains, addresses and threads of what was found and matters, and at last by one residual pass.

    What matters in a hop offers its correspondents' domains, their addresses, and its thread; domains of shared providers and of services that all use lead nowhere, and
    neither do automated addresses, the own one, and threads without own outbound mail. A domain finds mail of the domains under it too. When nothing new is offered, or after so many hops,
    mail that is addressed to the own account and carries no noise label is taken in, once; nothing is harvested from that.
    via: seed, domain, address, thread (the first of these) or residual. messages: id, thread_id, direction, addresses (sender first), labels, matters.
    """
    own = own_address.lower()
    addresses = F.transform("addresses", lambda a: F.lower(F.trim(a)))
    with_domain = lambda df: df.filter(F.contains("address", F.lit("@")) & (F.col("address") != own)).withColumn("domain", nz.domain_of(F.col("address")))
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), c).alias("key")
    answered = messages.filter("direction = 'outbound'").select("thread_id").distinct()
    threads = messages.filter("matters AND thread_id IS NOT NULL").select("id", "thread_id").join(answered, "thread_id", "left_semi").select("id", key("t", F.col("thread_id")))
    each = with_domain(messages.filter("matters").select("id", F.explode(addresses).alias("address")))
    leads = (F.col("domain") != "") & ~nz.generic(F.col("domain")) & ~F.col("domain").isin(*nz.NEVER_RULED)
    offers = stage(each.filter(leads).select("id", key("d", F.col("domain"))).unionByName(each.filter(nz.automated(F.col("address")).isNull()).select("id", key("a", F.col("address")))).unionByName(threads).distinct())
    under = lambda df, *c: df.select(*c, F.explode(nz.suffixes(F.col("domain"))).alias("d")).select(*c, key("d", F.col("d"))).unionByName(df.select(*c, key("a", F.col("address"))))
    meets = stage(under(each, "id").unionByName(threads).distinct())
    # hops need what matters alone: keys, each with the hop that uses it
    start = stage(seeds.select("id").distinct())
    seen = fresh = start
    used = None
    for hop in range(1, hops + 1):
        keys = offers.join(fresh, "id", "left_semi").select("key").distinct()
        keys = stage((keys if used is None else keys.join(used, "key", "left_anti")).withColumn("hop", F.lit(hop)))
        used = keys if used is None else used.unionByName(keys)
        fresh = stage(meets.join(keys, "key", "left_semi").select("id").distinct().join(seen, "id", "left_anti"))
        if not fresh.limit(1).count():
            break
        seen = seen.unionByName(fresh)
    first = start.select("id", F.lit(0).alias("hop"), F.lit("seed").alias("via"))
    # all other mail, once: the least of its addresses and of its thread, by hop and then by kind
    order = F.when(F.col("key").startswith("d:"), 0).when(F.col("key").startswith("a:"), 1).otherwise(2)
    never = 3 * (hops + 2)
    used = (messages.sparkSession.createDataFrame([], "key string, hop int") if used is None else used).withColumn("at", F.col("hop") * 3 + order)
    of_threads = stage(used.filter(F.col("key").startswith("t:")).select(F.expr("substr(key, 3)").alias("thread_id"), F.col("at").alias("by_thread")))
    people = with_domain(messages.select(F.explode(addresses).alias("address")).distinct())
    of_people = stage(under(people, "address").join(used, "key").groupBy("address").agg(F.min("at").alias("by_address")))
    rows = messages.select("id", "thread_id", F.when(residual(own_address), never).alias("rest"), addresses.alias("addresses")).join(of_threads, "thread_id", "left")
    rows = rows.select("id", F.least("rest", "by_thread").alias("at"), F.explode_outer("addresses").alias("address")).join(of_people, "address", "left").select("id", F.least("at", "by_address").alias("at"))
    found = stage(rows.filter("at IS NOT NULL").groupBy("id").agg(F.min("at").alias("at")).join(start, "id", "left_anti"))
    last = found.filter(F.col("at") < never).agg(F.max("at")).first()[0]
    rest = F.col("at") == never
    hop = F.when(rest, 0 if last is None else last // 3).otherwise(F.floor(F.col("at") / 3).cast("int"))
    via = F.when(rest, "residual").otherwise(F.element_at(F.array(*map(F.lit, KINDS.values())), F.col("at") % 3 + 1))
    return first.unionByName(found.select("id", (hop + F.when(rest, 1).otherwise(0)).alias("hop"), via.alias("via")))
