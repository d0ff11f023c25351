"""Work that must follow distinct senders and reduced rows, and not the mail."""

from ledgerline.operators import reading, rules, upkeep

RULES = "match_type string, value string, verdict string, category string, company_id string, source string"


def _known(spark):
    return spark.createDataFrame([("domain", "x.example", "negative", None, None, "llm"), ("address", "a@mail.x.example", "positive", None, "c", "human")], RULES)


def _watch(monkeypatch, name):
    """Rows that each call of rules.<name> is given first."""
    real, seen = getattr(rules, name), []

    def watched(rows, *rest, **more):
        seen.append(rows.count())
        return real(rows, *rest, **more)

    monkeypatch.setattr(rules, name, watched)
    return seen


def test_each_address_meets_the_rules_once(spark, monkeypatch):
    seen = _watch(monkeypatch, "_of_addresses")
    mail = spark.range(60).selectExpr("cast(id AS string) AS id", "CASE WHEN id % 2 = 0 THEN array('B@mail.x.example', 'a@mail.x.example') ELSE array('c@y.example', 'b@x.example') END AS addresses")
    got = {(r.match_type, r.matched, r.verdict, int(r.id) % 2) for r in rules.match_rules(mail, _known(spark)).collect()}
    assert got == {("address", "a@mail.x.example", "positive", 0), ("domain", "x.example", "negative", 1)}
    assert seen == [4]


def test_passes_and_readings_match_senders_and_not_mail(spark, monkeypatch):
    seen = _watch(monkeypatch, "match_rules")
    mail = spark.range(60).selectExpr("cast(id AS string) AS id", "concat('p@', CASE id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END, '.example') AS address")
    read = mail.filter("address = 'p@y.example'").withColumnRenamed("address", "sender_address")
    assert [tuple(r) for r in upkeep.learning_passes(mail, _known(spark), read).orderBy("pass").collect()] == [(1, 40, 2), (2, 20, 3)]
    assert seen and max(seen) <= 3
    seen.clear()
    jobs = mail.selectExpr("id", "timestamp_ntz'2024-01-01' AS sent_at", "address AS sender_address", "'undecided' AS status", "false AS known_contact", "cast(null AS string) AS agency_domain", "false AS explored", "'cheap' AS tier")
    first = mail.selectExpr("id", "'negative' AS label", *[f"cast(null AS string) AS {c}" for c in reading.FIELDS[1:]])
    rows = reading.settle(jobs, first, first.limit(0), _known(spark)).collect()
    assert {r.teach.value for r in rows if r.teach} == {"y.example", "z.example"} and len(rows) == 60
    assert max(seen) <= 3


def test_rows_are_reduced_by_application_where_the_join_left_them(spark):
    import re

    from ledgerline.operators import scope
    from ledgerline.plans.adapters import record

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = record(spark, "/root/testdata/sf0.001")
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (scope.latest_stage(r, "company_id"), scope.last_message(r, "company_id"))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    for plan in plans:
        # both sides of the join with applications, and what is left of each application by company
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3 and "Aggregate(key=[application_id" in re.sub(r"#\d+L?", "", plan)


def test_each_name_and_domain_is_looked_up_once(spark, monkeypatch):
    from ledgerline.operators import resolve

    real, looked = resolve.stage, []
    monkeypatch.setattr(resolve, "stage", lambda df, *a: (looked.append(real(df, *a)), looked[-1])[1])
    companies = spark.createDataFrame([(1, "Acme Robotics", "acme.example"), (2, "Beta", None)], "id long, canonical_name string, domain string")
    rows = [(str(i), *[("ACME robotics Inc.", None), ("x", "Acme.example"), ("beta", "gmail.com"), (None, None), ("nobody", "no.example")][i % 5]) for i in range(50)]
    found = resolve.lookup_companies(spark.createDataFrame(rows, "id string, name string, domain string"), companies, resolve.company_aliases(companies)).collect()
    assert sorted((int(r.id), r.company_id) for r in found) == [(i, [1, 1, 2, None, None][i % 5]) for i in range(50)]
    assert [t.count() for t in looked] == [5]


def test_lists_of_recipients_are_worked_out_once(spark):
    from pyspark.sql import functions as F

    from ledgerline.functions import normalize as nz

    rows = [(["B@x", "b@X", None, "ME@own"], ["c@x", "b@x"], ["me@own"]), (None, ["d@x"], ["a@x", "A@x"]), ([], None, None)]
    mail = spark.createDataFrame(rows, "at array<string>, cc array<string>, sender array<string>")
    got = mail.select(nz.reply_recipients(F.lit(None).cast("array<string>"), F.reverse("sender"), F.col("at"), F.col("cc"), ["Me@own"]).alias("r"))
    assert [(r.r.to, r.r.cc) for r in got.collect()] == [(["B@x"], ["c@x"]), (["A@x"], ["d@x"]), ([], [])]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1


def test_derivations_are_compared_in_one_pass(spark):
    from ledgerline.operators import quality

    left = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), (None, 2), ("c", None)], "k string, n long")
    right = spark.createDataFrame([("a", 1), (None, 2), ("d", 4), ("d", 4)], "k string, n long")
    apart = quality.difference(left, right)
    assert apart._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.k, r.n, r.side) for r in apart.collect()) == [("a", 1, "left"), ("a", 1, "left"), ("c", None, "left"), ("d", 4, "right"), ("d", 4, "right")]
    assert apart.columns == ["k", "n", "side"]


def test_a_header_that_comes_again_is_read_once(monkeypatch):
    from email import headerregistry

    import pandas as pd

    from ledgerline.sources import envelopes as env

    real, read = headerregistry.HeaderRegistry.__call__, []
    monkeypatch.setattr(headerregistry.HeaderRegistry, "__call__", lambda self, name, value: (read.append(name), real(self, name, value))[1])
    mail = [f"From: A <a@x.example>\r\nTo: b@y.example\r\nMessage-ID: <{i}@x>\r\nDate: Mon, 02 Jan 2023 10:00:00 +0000\r\n\r\nhi".encode() for i in range(20)]
    (out,) = env._parse([pd.DataFrame({"storage_key": [str(i) for i in range(20)], "account": "b@y.example", "fetched_at": pd.Timestamp("2023-01-01"), "payload": mail})])
    assert out["senders"].tolist() == [["a@x.example"]] * 20 and out["message_id"].tolist() == [f"<{i}@x>" for i in range(20)]
    assert read.count("From") == 1 and read.count("Date") == 1 and read.count("Message-ID") == 20


def _shuffles(df):
    """Shuffles of a plan that broadcasts nothing."""
    spark, key = df.sparkSession, "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set(key, held)


def test_claims_and_chains_meet_where_they_were_staged(spark):
    from ledgerline.plans import registry

    for name in ("derivation_gates", "onboarding_claims"):
        assert _shuffles(registry.QUERIES[name](spark, "/root/testdata/sf0.001")) == 0
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_readings_meet_the_mail_where_it_was_staged(spark):
    from ledgerline.plans import registry

    assert _shuffles(registry.QUERIES["settled_readings"](spark, "/root/testdata/sf0.001")) == 0


def test_domains_are_taught_by_companies_and_not_by_mail(spark):
    """The first company of a domain pins it, a second mail of that company raises it; others in between change nothing."""
    rows = [("m1", "a.example", "A", 1), ("m2", "a.example", "B", 2), ("m3", "b.example", "A", 3), ("m4", "b.example", "B", 4), ("m5", "b.example", "A", 5), ("m6", "c.example", None, 6), ("m7", "c.example", "C", 7), ("m8", "y.example", "K", 8), ("m9", "z.example", "L", 9)]
    mail = spark.createDataFrame([(i, d, c, None, at) for i, d, c, at in rows], "id string, domain string, company_id string, kind string, at int")
    known = spark.createDataFrame([("domain", "Y.example", "undecided", None, "K", "auto"), ("domain", "z.example", "undecided", None, "K", "auto")], RULES)
    out = rules.teach_positive(mail, known)
    assert sorted(tuple(r) for r in out.select("domain", "company_id", "verdict").fillna("-").collect()) == [("a.example", "A", "undecided"), ("b.example", "A", "positive"), ("c.example", "-", "undecided"), ("y.example", "K", "positive")]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
