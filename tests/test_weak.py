"""Agencies and contacts along threads, rules from triage and misses, positions over ranges, the timeline's parts."""

import random

from pyspark.sql import functions as F

from ledgerline.operators import quality, upkeep

RULES = "match_type string, value string, verdict string, category string, company_id long, source string"


def test_positions_equal_a_sort(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, name string, n int").repartition(7)
    got = {r["id"]: r["position"] for r in upkeep.numbered(df, [F.desc("n"), F.col("name").asc_nulls_last(), F.col("id").asc()]).collect()}
    want = sorted(rows, key=lambda r: (-r[2], r[1] is None, r[1] or "", r[0]))
    assert got == {r[0]: k for k, r in enumerate(want, 1)}
    assert upkeep.numbered(df.limit(0), [F.col("id").asc()]).count() == 0


def test_triage_teaches_addresses_alone(spark):
    known = spark.createDataFrame([("domain", "covered.example", "undecided", None, None, "llm")], RULES)
    rows = [("1", "News@Shop.example"), ("2", "news@shop.example"), ("3", "x@mail.covered.example"), ("4", "me@own.example"), ("5", None), ("6", "nobody")]
    out = upkeep.triage_negatives(spark.createDataFrame(rows, "id string, sender_address string"), known, "me@own.example").collect()
    assert sorted((r["match_type"], r["value"], r["verdict"]) for r in out) == [("address", "news@shop.example", "negative"), ("domain", "covered.example", "undecided")]


def test_misses_teach_and_demote(spark):
    known = spark.createDataFrame([("domain", "a.example", "positive", None, 1, "auto"), ("domain", "b.example", "positive", None, 2, "human"), ("domain", "c.example", "negative", None, None, "auto"), ("address", "x@b.example", "positive", None, None, "human")], RULES)
    misses = [(str(i), s) for i, s in enumerate(["feed@a.example"] * 3 + ["one@a.example"] * 2 + ["x@b.example"] * 4 + ["y@c.example", None])]
    out = {(r["match_type"], r["value"]): (r["verdict"], r["source"]) for r in upkeep.teach_from_misses(spark.createDataFrame(misses, "id string, sender_address string"), known).collect()}
    assert out == {
        ("domain", "a.example"): ("undecided", "auto"), ("domain", "b.example"): ("positive", "human"), ("domain", "c.example"): ("negative", "auto"),
        ("address", "x@b.example"): ("positive", "human"), ("address", "feed@a.example"): ("negative", "audit"),
    }


def test_people_and_agencies_go_along(spark):
    mail = spark.createDataFrame([("1", "t", 1, 10, 100, "p1"), ("2", "t", 2, 11, None, None), ("3", "t", 3, None, None, None), ("4", "u", 4, None, None, "keep"), ("5", None, 5, None, None, None)], "id string, thread_id string, sent_at int, company_id long, application_id long, contact_id string")
    links = spark.createDataFrame([("2", 70, "agency"), ("2", 60, "agency"), ("2", 50, "other"), ("1", 90, "agency")], "message_id string, company_id long, role string")
    out, more = upkeep.carry_people(mail, links)
    assert {r["id"]: (r["company_id"], r["application_id"], r["contact_id"]) for r in out.collect()} == {"1": (10, 100, "p1"), "2": (11, None, None), "3": (11, None, None), "4": (None, None, "keep"), "5": (None, None, None)}
    assert {tuple(r) for r in more.collect()} - {tuple(r) for r in links.collect()} == {("3", 60, "agency")}


def test_names_that_begin_alike_are_one_company(spark):
    rows = [("Runwayml", "Runway", True), ("Run-Way", "runway ML", True), ("Acme", "Zenith", False), (None, "Acme", False), ("", "Acme", False), ("!!", "Acme", False)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select(quality.same_company(F.col("a"), F.col("b")).alias("same"), "want").collect()
    assert all(r["same"] == r["want"] for r in got)
    empty = spark.createDataFrame([], "label string, stage string, company string, sender_address string, gold_related boolean, gold_stage string, gold_company string")
    (r,) = quality.classification_scorecard(empty).collect()
    assert (r["f1"], r["automated_recall"], r["noise_accuracy"], r["webmail_guard"], r["webmail_n"]) == (0.0, 1.0, 1.0, 1.0, 0)
