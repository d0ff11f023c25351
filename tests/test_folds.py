"""Queries that SQL can't say, against brute force over whole tables; stream replays; staged tables."""

import itertools
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline import storage
from ledgerline.functions import normalize as nz
from ledgerline.operators import resolve, upkeep
from ledgerline.plans import intake, registry
from ledgerline.plans.adapters import record
from ledgerline.plans.entities import _named
from ledgerline.sources import envelopes as env
from ledgerline.streaming import jobs

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def words(title):
    return {w for w in re.split(r"[^a-z0-9]+", (title or "").lower()) if w} - set(nz.TITLE_STOPWORDS)


def brute_assign(rows):
    """rows (id, company, role, at, ends), by the definition: every application so far is looked at for every mention."""
    out, spans = {}, defaultdict(list)
    for i, company, role, at, ends in sorted(rows, key=lambda r: (r[3], r[0])):
        slack = timedelta(days=45)
        fitting = [a for a in spans[company] if a["from"] - slack <= at <= (a["to"] or at) + slack]
        same = [a for a in fitting if words(role) and words(a["role"]) and len(words(role) & words(a["role"])) >= 0.6 * len(words(role) | words(a["role"]))]
        pool = same or [a for a in fitting if not a["role"]]
        pool.sort(key=lambda a: (abs(a["from"] - at), -a["from"].timestamp()))
        if not pool:
            pool = [{"from": at, "to": None, "role": role, "key": f"{company}-{i}"}]
            spans[company].append(pool[0])
        pool[0]["role"] = pool[0]["role"] or role
        if ends and pool[0]["to"] is None:
            pool[0]["to"] = at
        out[i] = (company, pool[0]["key"])
    return out


def test_assignment_equals_brute_force(spark):
    r = record(spark, SF)
    rows = r.message.join(r.application.select(F.col("id").alias("application_id"), F.col("role_title").alias("role")), "application_id")
    rows = rows.select("id", "company_id", "role", F.col("sent_at").alias("at"), (F.col("direction") == "outbound").alias("ends")).toPandas()
    want = brute_assign([(a, b, c if isinstance(c, str) else None, d.to_pydatetime(), e) for a, b, c, d, e in rows.itertuples(index=False)])
    got = {x["id"]: (x["company_id"], x["application"]) for x in registry.QUERIES["assign_applications"](spark, SF).collect()}
    assert got == want and len({a for _, a in got.values()}) > 300


def test_streamed_assignment_equals_brute_force(spark):
    rows = intake.mentions_of_events(spark.read.parquet(f"{SF}/events.parquet")).toPandas()
    want = brute_assign([(a, b, c if isinstance(c, str) else None, d.to_pydatetime(), e) for b, a, c, d, e in rows.itertuples(index=False)])
    got = {x["id"]: (x["company_id"], x["application"]) for x in registry.QUERIES["stream_applications"](spark, SF).collect()}
    assert got == want


def test_state_goes_on_where_a_batch_ended():
    rows = pd.DataFrame([(str(i), 1, ["a b", None, "c d"][i % 3], pd.Timestamp(T0) + pd.Timedelta(days=11 * i), i % 4 == 3) for i in range(40)], columns=["id", "company_id", "role", "at", "ends"])
    whole = resolve.Applications().add(rows)
    fold, parts = resolve.Applications(), []
    for at in range(0, 40, 7):
        fold = resolve.Applications.load(fold.dump())
        parts.append(fold.add(rows[at : at + 7]))
    assert pd.concat(parts, ignore_index=True).equals(whole)


def test_a_company_in_many_batches_is_one_fold(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(f"{i:03}", 5 if i % 3 else 6, "Data Engineer" if i % 2 else None, T0 + timedelta(days=9 * i), i % 7 == 0) for i in range(60)]
        got = {x["id"]: (x["company_id"], x["application"]) for x in resolve.assign_applications(spark.createDataFrame(rows, "id string, company_id long, role string, at timestamp_ntz, ends boolean")).collect()}
        assert got == brute_assign(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_created_companies_equal_brute_force(spark):
    r = record(spark, SF)
    rows = r.message.filter("classified_by = 'model-x'").select("id", F.expr("concat('Acme ', CAST(application_id % 97 AS STRING))").alias("name"), F.expr("CASE WHEN application_id % 5 = 0 THEN concat('acme', CAST(application_id % 97 AS STRING), '.example') END").alias("domain"), F.col("sent_at").alias("at")).collect()
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for x in rows:
        squashed = x["name"].lower().replace(" ", "")
        for form in (squashed, squashed if x["domain"] else None, x["domain"]):
            if form:
                top[root(form)] = root(x["id"])
    groups = defaultdict(list)
    for x in rows:
        groups[root(x["id"])].append(x)
    want = set()
    for g in groups.values():
        g.sort(key=lambda x: (x["at"], x["id"]))
        want.add((g[0]["id"], g[0]["name"], next((x["domain"] for x in g if x["domain"]), None), len(g)))
    got = {(x["first_id"], x["name"], x["domain"], x["mentions"]) for x in registry.QUERIES["create_companies"](spark, SF).collect()}
    assert got == want and len(got) > 50


def test_compatible_merges_equal_brute_force(spark):
    def flat(name):
        w = [x for x in re.split(r"[^a-z0-9]+", name.lower()) if x]
        while w and w[-1] in nz.SUFFIXES:
            w.pop()
        return "".join(w)

    companies = {x["id"]: (flat(x["canonical_name"]), x["domain"]) for x in _named(record(spark, SF)).collect()}
    got = registry.QUERIES["compatible_merges"](spark, SF).collect()
    seen = set()
    for x in got:
        (a, d), (b, e) = companies[x["left_id"]], companies[x["right_id"]]
        same_root = d and e and ".".join(d.split(".")[-2:]) == ".".join(e.split(".")[-2:])
        assert x["ok"] == bool(same_root or (a and b and (a in b or b in a)) or SequenceMatcher(None, a, b).ratio() > 0.75), x
        seen.add(x["ok"])
    pairs = {(x["left_id"], x["right_id"]) for x in got}
    assert seen and all((i, j) in pairs for (i, (a, d)), (j, (b, e)) in itertools.combinations(sorted(companies.items()), 2) if a and a == b and (not d or not e or d == e))


def test_similar_names_are_compatible(spark):
    rows = [("Acme Robotics", "Acme Robotix", None, None), ("Acme", "Zenith", "a.x.example", "b.x.example"), ("Acme", "Zenith", None, None), ("Blue Sky", "Blue Sky Labs Berlin", None, None)]
    got = [x["ok"] for x in resolve.compatible(spark.createDataFrame(rows, "left_name string, right_name string, left_domain string, right_domain string").coalesce(1)).collect()]
    assert got == [True, True, False, True]


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = spark.createDataFrame([("mail", str(i), "me", T0, bytearray(b"x%d" % i), {"occurred_at": f"202{i % 3}-01-02 03:04:05"} if i else {}) for i in range(9)], "source string, external_id string, account string, fetched_at timestamp, payload binary, metadata map<string,string>")
    lines = [r["value"] for r in env.to_lines(good).collect()]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([*lines, "{broken", lines[0]]) + "\n")
    for _ in range(2):  # a fresh checkpoint: the same batch, under the same number
        jobs.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / f"c{_}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/archive")).count() == 9
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 1


def test_late_mail_widens_both_ways(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("who string, at timestamp").json(str(tmp_path / "in"))
    for k, days in enumerate([(5, 6), (1, 9)]):
        (tmp_path / "in" / f"{k}.json").write_text("".join(f'{{"who": "a", "at": "2024-01-0{d}T00:00:00"}}\n' for d in days))
        out = jobs.drain(jobs.seen_ranges(stream, "who", "at"), str(tmp_path / "out"), str(tmp_path / "check"))
    (row,) = out.collect()
    assert (row["first_at"].day, row["last_at"].day, row["n"]) == (1, 9, 4)


def test_staged_tables_go(spark):
    df = storage.stage(spark.range(5))
    assert df.count() == 5 and storage.clear(spark) >= 1 and storage.clear(spark) == 0


def test_buckets_spare_a_shuffle(spark):
    left = storage.stage(spark.range(100).withColumn("v", F.col("id") % 7), by="id")
    plan = left.groupBy("id").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and left.count() == 100


def test_residual_and_cursors_of_nothing(spark):
    none = spark.createDataFrame([], "source string, account string, mark timestamp")
    batch = spark.createDataFrame([("mail", "a", T0, False), ("mail", "b", T0, True), ("chat", "a", None, False)], "source string, account string, sent_at timestamp, failed boolean")
    got = {(r["source"], r["account"]): r["mark"] for r in upkeep.advance_cursors(none, batch).collect()}
    assert got == {("mail", "a"): T0, ("mail", "b"): None, ("chat", "a"): None}
    mail = spark.createDataFrame([("1", ["x@y.z", "Me@own.example"], None), ("2", ["me@own.example"], None), ("3", ["x@y.z", "me@own.example"], ["CATEGORY_SOCIAL"]), ("4", [], None)], "id string, addresses array<string>, labels array<string>")
    assert [r["id"] for r in mail.filter(upkeep.residual("me@own.example")).collect()] == ["1"]


@pytest.mark.parametrize("name", ["create_companies", "assign_applications", "compatible_merges", "stream_applications"])
def test_without_oracle_is_what_is_listed_here(name):
    assert name in registry.QUERIES and name not in registry.ORACLES


def test_candidate_classes_lose_no_pair(spark):
    """Pairs of classes, written out, are all pairs by the rule: names, labels, own, shared and nested domains, and names of nothing."""
    rng = random.Random(5)
    words, domains = ["acme", "blue", "labs", "co", "robotics", "acmelabs", "7"], [None, None, "gmail.com", "acme.example", "eu.acme.example", "blue.example", "www.Blue.example", "acmelabs.example", "zeta.example", "co7.example"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 4))).title() if i % 17 else "Inc", rng.choice(domains)) for i in range(160)]
    flat = {i: tuple(w for w in re.split(r"[^a-z0-9]+", n.lower()) if w) for i, n, _ in rows}
    for i, w in flat.items():
        while w and w[-1] in nz.SUFFIXES:
            w = w[:-1]
        flat[i] = w
    own = {i: d.lower().removeprefix("www.") if d and d != "gmail.com" else None for i, _, d in rows}
    want = set()
    for x, y in itertools.combinations(flat, 2):
        a, b, d, e = flat[x], flat[y], own[x], own[y]
        if d and e and d != e and not d.endswith("." + e) and not e.endswith("." + d):
            continue
        share = len({*a} & {*b}) / min(len({*a}), len({*b})) if a and b else 0
        holds = lambda name, dom: bool(name and dom and (dom.split(".")[0] == "".join(name) or dom.split(".")[0] in " ".join(name) or " ".join(name) in dom.split(".")[0]))
        score = 1.0 if a and a == b else 0.9 if share >= 1 else 0.6 if share >= 0.6 else 0.8 if holds(a, e) or holds(b, d) else None
        if score:
            want.add((x, y, score))
    found = resolve.merge_candidates(spark.createDataFrame(rows, "id long, canonical_name string, domain string")).cache()
    got = [(r["left_id"], r["right_id"], r["score"]) for r in resolve.candidate_pairs(found, None).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {s for _, _, s in want} == {1.0, 0.9, 0.6, 0.8}
    assert found.filter("reason <> 'member'").count() < len(want) / 2 and found.filter("reason = 'member'").count() == len(rows)
    first = [(r["left_id"], r["right_id"], r["score"]) for r in resolve.candidate_pairs(found, 30).collect()]
    assert first == sorted(want, key=lambda p: (-p[2], p[0], p[1]))[:30]
    found.unpersist()


def test_the_query_lists_companies_and_not_classes(spark, monkeypatch):
    """Each pair of companies is a row, also of classes that are longer than a block."""
    monkeypatch.setattr(resolve, "_BLOCK", 2)
    rows = registry.QUERIES["merge_candidates"](spark, "/root/testdata/sf0.001")
    assert rows.columns == ["left_id", "right_id", "reason", "score"] and rows.filter("left_id >= right_id").count() == 0
    got = {(r["left_id"], r["right_id"]) for r in rows.collect()}
    # the shared words of these names are enough wherever one of both has no domain
    ids = range(0, 150, 3)
    named = {r["id"] for r in record(spark, "/root/testdata/sf0.001").company.collect()}
    want = {(x, y) for x in ids for y in ids if x < y and {x, y} <= named and (x % 7 == 0 or y % 7 == 0)}
    assert want and want <= got and len(got) == rows.count()
