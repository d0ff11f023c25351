"""Small tables in, expected tables out."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import normalize as nz
from ledgerline.operators import classify, mutate, quality, resolve, rules, search, stages
from ledgerline.sources import envelopes as env
from ledgerline.streaming import jobs

T0 = datetime(2024, 1, 1, 9)
EVENTS = "id string, application_id string, stage string, occurred_at timestamp"


def events(spark, *rows):
    """(id, stage, hours) of application a."""
    return spark.createDataFrame([(i, "a", s, T0 + timedelta(hours=h)) for i, s, h in rows], EVENTS)


def shown(df):
    return [(r["id"], r["stage"]) for r in df.orderBy("occurred_at", "id").collect()]


def test_runs_collapse_to_their_earliest(spark):
    rows = events(spark, ("3", "technical", 30), ("1", "applied", 0), ("2", "applied", 5), ("4", "applied", 40))
    assert shown(stages.collapse_runs(rows)) == [("1", "applied"), ("3", "technical"), ("4", "applied")]
    assert stages.collapse_runs(rows.limit(0)).count() == 0


def test_windows_are_anchored_at_their_first_event(spark):
    rows = events(spark, ("1", "applied", 0), ("2", "technical", 20), ("3", "phone_screen", 30), ("4", "rejected", 31), ("5", "onsite", 32))
    got = stages.resolve_windows(rows).orderBy("occurred_at", "id").collect()
    assert [(r["id"], r["stage"], r["occurred_at"]) for r in got] == [
        ("2", "technical", T0), ("3", "phone_screen", T0 + timedelta(hours=30)), ("4", "rejected", T0 + timedelta(hours=31)), ("5", "onsite", T0 + timedelta(hours=32)),
    ]


def test_timeline_is_stable(spark):
    rows = events(spark, ("1", "applied", 0), ("2", "applied", 1), ("3", "phone_screen", 3), ("4", "phone_screen", 50), ("5", "accepted", 60))
    once = stages.timeline(rows)
    assert quality.difference(once, stages.timeline(once)).count() == 0


def test_forward_order_drops_contradictions(spark):
    rows = events(spark, ("1", "applied", 0), ("2", "technical", 1), ("3", "phone_screen", 2), ("4", "offer", 3), ("5", "accepted", 4), ("6", "onsite", 5), ("7", "declined", 6))
    assert [i for i, _ in shown(stages.forward_order(rows))] == ["1", "2", "4", "5", "7"]


def test_latest_batch_ranks_unstamped_oldest(spark):
    rows = spark.createDataFrame([("1", "a", None), ("2", "a", T0), ("3", "a", T0 + timedelta(days=1)), ("4", "b", None)], "id string, application_id string, derived_at timestamp")
    assert {r["id"] for r in stages.latest_batch(rows).collect()} == {"3", "4"}


def test_acceptance_needs_corroboration_for_ambiguous_words(spark):
    def index(*subjects):
        df = spark.createDataFrame([("a", i, s) for i, s in enumerate(subjects)], "application_id string, idx int, subject string")
        found = stages.accepted_index(df).collect()
        return found[0]["idx"] if found else None

    assert index("Interview", "Welcome to Acme") == 1
    assert index("Immigration questions", "Hello") is None
    assert index("Petition filed", "Immigration update") == 1
    assert index("Welcome to our newsletter") is None
    assert index(None, "I-9 form") == 1


def test_conversation_goes_to_the_span_that_holds_it(spark):
    apps = spark.createDataFrame([(1, 9, T0, T0 + timedelta(days=10)), (2, 9, T0 + timedelta(days=20), T0 + timedelta(days=30))], "id int, company_id int, started_at timestamp, last_at timestamp")
    calls = spark.createDataFrame([("in", 9, T0 + timedelta(days=5)), ("near", 9, T0 + timedelta(days=33))], "conversation_id string, company_id int, occurred_at timestamp")
    assert {r["conversation_id"]: r["application_id"] for r in stages.conversation_application(calls, apps).collect()} == {"in": 1, "near": 2}


def test_address_rule_beats_domain_rule_and_own_address_matches_nothing(spark):
    known = spark.createDataFrame([("domain", "x.example", "negative", 1, None), ("address", "ann@mail.x.example", "positive", 2, None), ("address", "me@own.example", "undecided", 3, None)], "match_type string, value string, verdict string, company_id long, category string")
    mail = spark.createDataFrame([("1", ["Ann@mail.x.example", "me@own.example"]), ("2", ["bob@a.b.x.example"]), ("3", ["me@own.example"]), ("4", ["x.example"]), ("5", [])], "id string, addresses array<string>")
    got = {r["id"]: r["verdict"] for r in rules.match_rules(mail, known, "me@own.example").collect()}
    assert got == {"1": "positive", "2": "negative"}


def test_promotion_by_the_pinned_company_only(spark):
    read = lambda *cs: spark.createDataFrame([(str(i), "x.example", c, "employer", T0 + timedelta(days=i)) for i, c in enumerate(cs)], "id string, domain string, company_id long, kind string, at timestamp")
    none = spark.createDataFrame([], "match_type string, value string, verdict string, company_id long, source string")
    taught = lambda *cs: [(r["company_id"], r["verdict"]) for r in rules.teach_positive(read(*cs), none).collect()]
    assert taught(1) == [(1, "undecided")]
    assert taught(1, 1) == [(1, "positive")]
    assert taught(1, 2) == [(1, "undecided")]
    assert taught(1, 2, 1) == [(1, "positive")]


def test_same_role_years_apart_is_another_application(spark):
    rows = [("1", 7, "Senior Backend Engineer", T0, False), ("2", 7, "Backend Engineer", T0 + timedelta(days=10), True), ("3", 7, "Backend Engineer", T0 + timedelta(days=900), False), ("4", 7, None, T0 + timedelta(days=905), False)]
    got = {r["id"]: r["application"] for r in resolve.assign_applications(spark.createDataFrame(rows, "id string, company_id long, role string, at timestamp, ends boolean")).collect()}
    assert got["1"] == got["2"] and got["3"] != got["1"]


def test_creation_follows_shared_forms_to_their_end(spark):
    rows = [("a", "Acme Robotics", None, T0), ("b", "AcmeRobotics Inc", "acme.example", T0 + timedelta(days=1)), ("c", None, "acme.example", T0 + timedelta(days=2)), ("d", "Other", None, T0)]
    got = {r["first_id"]: (r["name"], r["domain"], r["mentions"]) for r in resolve.create_companies(spark.createDataFrame(rows, "id string, name string, domain string, at timestamp")).collect()}
    assert got == {"a": ("Acme Robotics", "acme.example", 3), "d": ("Other", None, 1)}


def test_inserts_are_idempotent(spark):
    table = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k int, v string")
    once = mutate.insert_absent(table, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c")]
    assert quality.difference(once, mutate.insert_absent(once, new, ["k"])).count() == 0


def test_query_syntax():
    assert search.parse_query('alpha OR "beta gamma" delta -"no way" -x') == ([[["alpha"], ["beta", "gamma"]], [["delta"]]], [["no", "way"], ["x"]])
    assert search.parse_query("OR -  ") == ([], [])


def test_names_and_domains(spark):
    row = spark.range(1).select(
        nz.normalise_company(F.lit("Acme, Inc. Holdings")).alias("a"), nz.normalise_company(F.lit("Inc")).alias("b"), nz.normalise_domain(F.lit(" HTTPS://www.Acme.io./x ")).alias("c"),
        nz.generic(F.lit("mail.gmail.com")).alias("d"), nz.generic(F.lit("notgmail.com")).alias("e"), nz.automated(F.lit("<No-Reply-7@x.io>")).alias("f"), nz.domain_of(F.lit("A@B@C>")).alias("g"),
        nz.names_a_company(F.lit("stealth startup"), F.lit(None).cast("string")).alias("h"), nz.names_a_company(F.lit("Acme"), F.lit(None).cast("string")).alias("i"),
        nz.same_role(F.lit("Sr Data Engineer"), F.lit("data engineer")).alias("j"), nz.clean(F.lit(" None ")).alias("k"), F.size(nz.suffixes(F.lit("com"))).alias("l"),
    ).first()
    assert tuple(row) == ("acme", "", "acme.io", True, False, "no-reply", "b@c", False, True, True, None, 0)


def test_quotes_and_markup_are_cut(spark):
    text = "Yes.\r\nSee you\xa0there\r\nOn Monday Ann wrote:\r\n> hi"
    html = "<style>x</style><p>A &amp; B</p><script>var t='</p>'</script> &lt;c"
    row = spark.range(1).select(nz.body_text(F.lit(text), F.lit(None).cast("string")), nz.body_text(F.lit(None).cast("string"), F.lit(html)), nz.body_text(F.lit(None).cast("string"), F.lit(None).cast("string"))).first()
    assert row[0] == "Yes.\nSee you there" and row[1] == "A & B <c" and row[2] == ""


def test_exploration_is_the_md5_modulo(spark):
    import hashlib

    ids = [f"m{i}" for i in range(400)]
    got = {r["i"] for r in spark.createDataFrame([(i,) for i in ids], "i string").filter(nz.explored(F.lit("domain"), F.lit("X.example"), F.col("i"))).collect()}
    assert got == {i for i in ids if int(hashlib.md5(f"domain:x.example:{i}".encode()).hexdigest(), 16) % 10_000 < 200}


def test_envelopes_round_trip_and_quarantine(spark):
    rows = spark.createDataFrame([("mail", "1", "me", T0, bytearray(b"a\x00b"), {"occurred_at": "2024-01-02 03:04:05"}), ("mail", "2", "me", T0, bytearray(b""), None)], "source string, external_id string, account string, fetched_at timestamp, payload binary, metadata map<string,string>")
    lines = env.to_lines(rows).select(F.col("value").alias("line"))
    good, bad = env.split_envelopes(lines.unionByName(spark.createDataFrame([("{broken",), ('{"v": 2, "source": "x", "payload_b64": ""}',), (None,)], "line string")))
    assert {(r["external_id"], bytes(r["payload"])) for r in good.collect()} == {("1", b"a\x00b"), ("2", b"")}
    assert bad.count() == 3
    keyed = env.with_keys(good)
    assert {r["storage_key"].split("_")[0] for r in keyed.collect()} == {"raw/mail/2024/01/02/030405", "raw/mail/unknown-date/unknown-date/unknown-date/000000"}
    assert env.write_once(env.write_once(None, keyed), keyed).count() == 0


def test_read_only_refuses_writes(spark):
    with pytest.raises(ValueError):
        env.read_only(spark, "DROP TABLE x")
    assert env.read_only(spark, "SELECT 1 AS one").first()["one"] == 1


def test_classification_loop_ends(spark):
    left = [3, 2, 1, 0]
    ran = jobs.classify_loop(lambda: spark.range(left.pop(0)), lambda b: b, lambda d: None)
    assert ran == 3


def test_deleting_a_company_returns_its_mail(spark):
    companies = spark.createDataFrame([(1,), (2,)], "id long")
    apps = spark.createDataFrame([(10, 1), (20, 2)], "id long, company_id long")
    ev = spark.createDataFrame([("e1", 10), ("e2", 20)], "id string, application_id long")
    mail = spark.createDataFrame([("a", 1, 10, "model"), ("b", 2, 20, "model"), ("c", None, None, None)], "id string, company_id long, application_id long, classified_by string")
    c, a, e, m = mutate.delete_companies(companies, apps, ev, mail, companies.filter("id = 1"))
    assert [r["id"] for r in c.collect()] == [2] and [r["id"] for r in a.collect()] == [20] and [r["id"] for r in e.collect()] == ["e2"]
    assert {r["id"]: (r["company_id"], r["classified_by"]) for r in m.collect()} == {"a": (None, None), "b": (2, "model"), "c": (None, None)}


def test_verdicts_name_their_reasons(spark):
    cols = "learned string, known boolean, thread boolean, labels array<string>, bulk boolean"
    rows = [(None, False, False, None, False), ("negative", True, False, [], True), ("undecided", False, False, ["CATEGORY_SOCIAL"], False), (None, False, False, ["INBOX", "CATEGORY_FORUMS"], False), (None, False, False, [], True)]
    got = [tuple(r["v"]) for r in spark.createDataFrame(rows, cols).select(rules.verdict(*[F.col(c.split()[0]) for c in cols.split(", ")]).alias("v")).collect()]
    assert [(s, list(w)) for s, w in got] == [
        ("undecided", []), ("positive", ["known-contact", "learned:negative", "bulk-header"]), ("undecided", ["learned:undecided", "label:CATEGORY_SOCIAL"]), ("negative", ["label:CATEGORY_FORUMS"]), ("undecided", ["bulk-header"]),
    ]


def test_readings_of_odd_shape_are_errors(spark):

    raw = ['{"label": "positive", "stage": " OFFER ", "company_name": "None"}', '[{"label": "x"}]', '[{"label": "positive"}, {}]', "[]", "text", "", None, "3"]
    got = [(r["ok"], r["label"], r["stage"], r["company_name"]) for r in classify.coerce(spark.createDataFrame(list(enumerate(raw)), "id int, raw string")).orderBy("id").collect()]
    assert got == [(True, "positive", "offer", None), (True, "unclassified", None, None)] + [(False, None, None, None)] * 6


def test_scorecard_of_nothing(spark):
    row = quality.scorecard(spark.createDataFrame([], "predicted boolean, gold boolean")).first()
    assert (row["precision"], row["recall"], row["f1"], row["noise_accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_long_texts_stay_whole(spark):
    long = "word " * 10_000 + "end"
    none = F.lit(None).cast("string")
    html = F.lit("<p>" + long + "</p>")
    row = spark.range(1).select(nz.body_text(F.lit(long), none), nz.body_text(none, html), search.embedding_text(F.lit(long), none), F.length(nz.body_text(none, html, 20_000))).first()
    assert tuple(row) == (long, long, long, 20_000)


def test_semantic_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "ASKED", 3)
    monkeypatch.setattr(search, "SEARCHED", 7)
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 1) for _ in range(4 if i % 5 else 3)]) for i in range(60)]
    rows[9] = (9, list(rows[8][1]))  # a tie
    odd = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 1.0, 0.0, 0.0]), (104, [float("inf"), 1.0, 0.0, 0.0]), (105, [])]
    table = spark.createDataFrame(rows + odd, "vec_id int, embedding array<double>")

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 9)

    def best(own):
        return {q: [i for _, i in sorted((-cosine(a, b), i) for i, b in rows if len(a) == len(b) and (own or i != q))[:4]] for q, a in rows}

    for own, found in ((True, search.semantic(table, table, 4)), (False, search.neighbours(table, table, 4))):
        got = {}
        for r in found.orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["id"])
        assert got == best(own)
    assert search.semantic(table.limit(0), table, 4).count() == 0
    assert search.neighbours(table, table.filter("vec_id >= 100"), 4).count() == 0


def test_audit_plans(spark):
    applications = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (6, 3), (7, None)], "id int, company_id int")
    verdicts = spark.createDataFrame([(1, "merge", 2), (3, "merge", 1), (4, "delete", None), (5, "merge", 1), (6, "delete", None)], "id int, verdict string, target int")
    # 3 would go into what is merged itself, 4 is its company's only one, 5 would leave its company
    assert sorted(map(tuple, classify.audit_applications(applications, verdicts).collect())) == [(1, "merge", 2), (6, "delete", None)]
    companies = spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (4, "D"), (5, "E")], "id int, canonical_name string")
    said = spark.createDataFrame([(1, "junk", None, None), (2, "duplicate", 1, None), (3, "misnamed", None, " C "), (4, "duplicate", 3, "x"), (5, "person", None, "E"), (9, "junk", None, None)], "id int, verdict string, target int, name string")
    assert sorted(map(tuple, classify.audit_companies(companies, said).collect()), key=lambda r: r[0]) == [(1, "delete", None, None), (3, "rename", None, "C"), (4, "merge", 3, None)]
