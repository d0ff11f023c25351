"""Expansion against a plain search, and tables that hold messages: as many whatever the hops."""

import random

import pytest

from ledgerline.operators import expand


def _mail(seed):
    rng = random.Random(seed)
    rows = [(f"m{i:03}", rng.choice([f"t{rng.randrange(60)}", None]), rng.choice([f"d{rng.randrange(70)}.example", "gmail.com", None]), rng.choice(["outbound", "inbound", "inbound"])) for i in range(150)]
    return rows + rows[:3]  # some mail twice


def _search(rows, keys, offers, start, hops):
    """(id: hop, least key) by hops from keys to messages."""
    seen, used, frontier = {i: (0, None) for i in start}, set(), set(start)
    for hop in range(1, hops + 1):
        new = {k for i in frontier for k in offers.get(i, ())} - used
        fresh = {i: min(keys[i] & new, key=lambda k: "dat".index(k[0])) for i in {r[0] for r in rows} - set(seen) if keys[i] & new}
        if not fresh:
            break
        used |= new
        seen |= {i: (hop, k) for i, k in fresh.items()}
        frontier = set(fresh)
    return seen


@pytest.fixture
def staged(monkeypatch):
    """Columns of all tables that an expansion writes, and the tables."""
    real, columns, tables = expand.stage, [], []
    monkeypatch.setattr(expand, "stage", lambda df, *a, **k: (columns.append(df.columns), tables.append(real(df, *a, **k)), tables[-1])[2])
    return columns, tables


@pytest.mark.parametrize("hops", [1, 4])
def test_expansion_equals_a_search(spark, staged, hops):
    rows = _mail(hops)
    own = {t for _, t, _, w in rows if w == "outbound"} - {None}
    keys = {i: ({f"t:{t}"} if t in own else set()) | ({f"d:{d}"} if d and d != "gmail.com" else set()) for i, t, d, _ in rows}
    mail = spark.createDataFrame(rows, "id string, thread_id string, sender_domain string, direction string")
    got = expand.expand(mail, spark.createDataFrame([("m001",), ("m002",), ("gone",)], "id string"), hops).collect()
    want = _search(rows, keys, keys, ["m001", "m002", "gone"], hops)
    assert sorted(map(tuple, got)) == sorted((i, h) for i, (h, _) in want.items())
    assert sum("id" in c for c in staged[0]) == 2  # seeds and mail


@pytest.mark.parametrize("hops", [1, 4])
def test_record_expansion_equals_a_search(spark, staged, hops):
    rng = random.Random(hops)
    me = "Me@own.example"
    rows = []
    for i, t, _, w in _mail(hops)[:150]:
        people = [f"{rng.choice('ab')}{rng.randrange(40)}@{rng.choice(['', 'mail.'])}d{rng.randrange(40)}.example", me if rng.random() < 0.2 else "x@gmail.com"]
        rows.append((i, t, w, rng.choice([people, people, None, ["nobody"]]), [], rng.choice([True, False, None])))
    own = {r[1] for r in rows if r[2] == "outbound"} - {None}
    offers, keys = {}, {}
    for i, t, _, people, _, matters in rows:
        held = [a.lower() for a in people or [] if "@" in a and a != me]
        domains = [a.split("@")[1] for a in held]
        thread = {f"t:{t}"} if t in own else set()
        keys[i] = {f"a:{a}" for a in held} | {f"d:{d}" for x in domains for d in (x, x.removeprefix("mail."))} | thread
        offers[i] = ({f"a:{a}" for a in held} | {f"d:{d}" for d in domains if d != "gmail.com"} | thread) if matters else set()
    mail = spark.createDataFrame(rows, "id string, thread_id string, direction string, addresses array<string>, labels array<string>, matters boolean")
    start = [r[0] for r in rows if r[5]][:2]
    got = sorted(map(tuple, expand.expand_record(mail, mail.filter(mail.id.isin(start)), me, hops).collect()))
    seen = _search(rows, keys, offers, start, hops)
    want = [(i, h, {"d": "domain", "a": "address", "t": "thread"}[k[0]] if k else "seed") for i, (h, k) in seen.items()]
    last = max(h for h, _ in seen.values())
    want += [(r[0], last + 1, "residual") for r in rows if r[0] not in seen and me in (r[3] or [])[1:]]
    assert got == sorted(want)
    # of the tables that hops read none holds mail that doesn't matter
    assert {r["id"] for t in staged[1] if t.columns == ["id", "key"] for r in t.collect()} <= {r[0] for r in rows if r[5]}
