"""Chains, components and teachings against brute force."""

import random
from datetime import datetime, timedelta

import pytest

from ledgerline.operators import graphs, upkeep
from ledgerline.plans import registry
from tests.oracle import TABLES, assert_equal, connect

SF = "/root/testdata/sf0.001"

T0 = datetime(2024, 1, 1)


def brute_chain(pairs):
    to = {}
    for a, b in sorted(pairs):
        if a != b:
            to.setdefault(a, b)
    out = {}
    for a in to:
        path, x = [a], a
        while x in to and to[x] not in path:
            x = to[x]
            path.append(x)
        end = x if x not in to else min(path[path.index(to[x]) :])
        if end != a:
            out[a] = end
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chains_are_followed_to_their_ends(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(37)] + [(200, 201), (201, 202), (202, 200), (205, 201), (300, 300)]
    got = {r["old"]: r["new"] for r in graphs.resolve_chains(spark.createDataFrame(pairs, "old long, new long")).collect()}
    assert got == brute_chain(pairs) and got[100] == 137 and got[205] == 200 and 200 not in got and 300 not in got
    assert graphs.resolve_chains(spark.createDataFrame([], "old long, new long")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_a_search(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(90)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("star", f"s{i}") for i in range(50)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    got = {r["node"]: r["root"] for r in graphs.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: root(x) for x in list(top)}


def brute_teach(taught, companies, aliases):
    """One teaching after another, as they came."""
    domains = {d.lower(): c for c, _, d in sorted(companies, reverse=True) if d}
    called = {}
    for c, a in sorted(aliases, key=lambda x: x[0], reverse=True):
        called[a.lower()] = c
    made, target = {}, {}
    for i, at, kind, value, verdict, company, domain, category in sorted(taught, key=lambda t: (t[1], t[0])):
        if verdict != "positive" or not (company or domain):
            continue
        d = (domain or (value if kind == "domain" else None) or "").lower() or None
        found = domains.get(d) if d else None
        if found is None and company:
            found = called.get(company.lower())
        if found is None:
            found = f"new-{i}"
            made[found] = (company or d or value, d)
            if d:
                domains[d] = found
            called.setdefault((company or d or value).lower(), found)
        target[i] = found
    return made, target


@pytest.mark.parametrize("seed", range(4))
def test_teachings_equal_one_after_another(spark, seed):
    rng = random.Random(seed)
    companies = [("c1", "Acme", "acme.example"), ("c2", "Zenith", None)]
    aliases = [("c1", "acme"), ("c2", "zenith"), ("c2", "zen")]
    taught = []
    for i in range(40):
        kind = rng.choice(["domain", "address"])
        value = f"d{rng.randrange(12)}.example" if kind == "domain" else f"p{i}@gmail.com"
        taught.append((f"t{i:02}", T0 + timedelta(minutes=rng.randrange(30)), kind, value, rng.choice(["positive", "positive", "negative", "undecided"]), rng.choice([None, "Zen", "New Firm", "new firm", "Other", f"Firm {i % 5}"]), rng.choice([None, None, f"d{rng.randrange(12)}.example", "ACME.example"]), rng.choice([None, None, "relays"])))
    made, target = brute_teach(taught, companies, aliases)
    frame = spark.createDataFrame([(*t, None) for t in taught], "id string, at timestamp, match_type string, value string, verdict string, company string, company_domain string, category string, kind string")
    known = spark.createDataFrame([("domain", "d1.example", "negative", None, None, "llm"), ("domain", "stay.example", "negative", None, None, "llm")], "match_type string, value string, verdict string, category string, company_id string, source string")
    cats = spark.createDataFrame([("agencies", "positive", "c1")], "category string, verdict string, company_id string")
    mail = spark.createDataFrame([("m1", ["x@sub.d3.example"], None, None), ("m2", ["x@stay.example"], None, None)], "id string, addresses array<string>, company_id string, classified_by string")
    out = upkeep.teach_batch(frame, spark.createDataFrame([(*c, "employer") for c in companies], "id string, canonical_name string, domain string, kind string"), spark.createDataFrame(aliases, "company_id string, alias string"), known, cats, mail)
    got = {r["id"]: (r["canonical_name"], r["domain"]) for r in out["companies"].collect() if r["id"].startswith("new-")}
    assert {k: (n.lower(), d) for k, (n, d) in got.items()} == {k: (n.lower(), d) for k, (n, d) in made.items()}
    last, group = {}, {}
    for t in sorted(taught, key=lambda t: (t[1], t[0])):
        if t[4] == "positive" and t[0] not in target:
            continue
        last[t[2], t[3].lower()] = (None, t[7], None) if t[7] else (t[4], None, target.get(t[0]))
        if t[7]:
            group[t[7]] = (t[4], target.get(t[0]))
    rules = {(r["match_type"], r["value"]): (r["verdict"], r["category"], r["company_id"]) for r in out["rules"].collect()}
    assert rules == {("domain", "d1.example"): ("negative", None, None), ("domain", "stay.example"): ("negative", None, None)} | last
    assert {r["category"]: (r["verdict"], r["company_id"]) for r in out["categories"].collect()} == {"agencies": ("positive", "c1")} | group


def test_no_rule_about_the_own_mailbox(spark):
    """Address and domain, in any writing, from verification, teaching and distillation alike."""
    known = spark.createDataFrame([], "match_type string, value string, verdict string, category string, company_id long, source string")
    rules = [("domain", "own.example", "negative"), ("address", "Me@Own.example", "negative"), ("domain", " OWN.example ", "undecided"), ("domain", "fine.example", "negative")]
    verdicts = spark.createDataFrame([(1, False, None, None, rules)], "company_id long, negative boolean, name string, kind string, rules array<struct<match_type:string,value:string,verdict:string>>")
    none = lambda s: spark.createDataFrame([], s)
    out = upkeep.apply_verifications(
        none("id long, canonical_name string, domain string, kind string"), none("id long, company_id long"), none("id string, application_id long"), none("id string, company_id long, application_id long, classified_by string"),
        known, none("company_id long, alias string"), verdicts, "me@own.example",
    )
    assert [r["value"] for r in out["rules"].collect()] == ["fine.example"] and out["verifications"].count() == 1
    candidates = spark.createDataFrame([(d, 0, 0) for d in ("calendly.com", "zoom.us", "own.example", "fine.example")] + [("read.example", 0, 2), ("held.example", 1, 0)], "sender_domain string, linked long, positive long")
    readings = candidates.selectExpr("sender_domain AS domain", "'negative' AS verdict")
    assert [r["value"] for r in upkeep.distilled(readings, candidates, known, "me@own.example").collect()] == ["fine.example"]


def test_texts_within_texts_meet(spark):
    """A rarest piece of the inner text brings every pair together, for short and long, equal and repeated texts."""
    from ledgerline.operators import resolve

    rng = random.Random(8)
    hay = [(i, "".join(rng.choices("abc ", k=rng.randint(1, 12)))) for i in range(120)]
    needles = [(1000 + i, "".join(rng.choices("abc", k=rng.randint(1, 5)))) for i in range(80)]
    got = {(r["x"], r["y"]) for r in resolve._holding(spark.createDataFrame(hay, "id long, name string"), "name", spark.createDataFrame(needles, "id long, label string"), "label").collect()}
    assert got == {(x, y) for x, h in hay for y, n in needles if n in h}


def test_teachings_of_one_domain_take_few_rounds(spark, monkeypatch):
    """Many teachings about a domain that no company has, by a name that one has, and a name that is another's domain."""
    taught = [(f"t{i:03}", T0 + timedelta(minutes=i), "domain", f"d{i % 6}.example", "positive", f"Firm {i % 2}", None) for i in range(120)]
    taught += [("u0", T0 + timedelta(days=1), "address", "a@gmail.com", "positive", None, "solo.example"), ("u1", T0 + timedelta(days=2), "domain", "z.example", "positive", "Solo.example", None)]
    frame = spark.createDataFrame([(*t, None, None) for t in taught], "id string, at timestamp, match_type string, value string, verdict string, company string, company_domain string, category string, kind string")
    empty = lambda schema: spark.createDataFrame([], schema)
    rounds, real = [], upkeep.stage
    monkeypatch.setattr(upkeep, "stage", lambda df, by=None: (rounds.append(1), real(df, by))[1])
    out = upkeep.teach_batch(frame, empty("id string, canonical_name string, domain string, kind string"), empty("company_id string, alias string"), empty("match_type string, value string, verdict string, category string, company_id string, source string"),
                             empty("category string, verdict string, company_id string"), empty("id string, addresses array<string>, company_id string, classified_by string"))
    made, target = brute_teach([(*t, None) for t in taught], [], [])
    assert len(rounds) < 10
    assert {r["id"]: (r["canonical_name"].lower(), r["domain"]) for r in out["companies"].collect()} == {k: (n.lower(), d) for k, (n, d) in made.items()}
    assert {r["value"]: r["company_id"] for r in out["rules"].collect()} == {t[3]: target[t[0]] for t in taught}


def test_links_to_a_company_that_is_not_there(spark, tmp_path):
    """The largest company's successor would be deleted or merged by its number, but no plan names it."""
    con = connect(SF)
    for t in TABLES:
        kept = {"customer": "WHERE c_custkey < 140", "orders": "WHERE o_custkey < 140"}.get(t, "")
        con.execute(f"COPY (SELECT * FROM {t} {kept}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    rows = registry.QUERIES["audited_links"](spark, str(tmp_path))
    assert rows.filter("company_id = 140").count() > 0
    assert_equal(rows, connect(tmp_path), registry.ORACLES["audited_links"])
