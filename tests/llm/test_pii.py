"""Personal data: base patterns against the plain regular expressions, the field on texts that it wasn't fitted to, and odd tables."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from ledgerline.llm import pii, queries

SF = "/root/testdata/sf0.001"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(k, *m.span()) for k, (p, fine) in enumerate(rules) for m in re.finditer(p, text or "") if fine(m)]


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    bits = ["a", "B.c", "@", "x@y.z", ".", "-", "%", "+", "1", "22", "300", "0255", "1.2.3.4", "4111111111111111", "4111 1111", "1111-1111", " ", "  ", "+1 (988) 555-2485", "(", ")", "é", "🙂", "\n", "_", "@b", "4929-1"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 30)))
        assert pii.base_spans(text) == brute(text), text


def test_base_spans_take_linear_time():
    began = time.time()
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "a@" * 500_000, "+1" * 500_000, "+1" + " " * 1_000_000, "1 " * 500_000, "a.b_" * 250_000, "Ab-" * 300_000, "(" * 1_000_000, "x" * 500_000 + "@a.b" * 10):
        assert isinstance(pii.base_spans(text), list) and isinstance(pii._tokens(text), list)
    assert time.time() - began < 30


def found(text, field):
    return [(pii.KINDS[k], text[s:e]) for k, s, e in pii.spans_of([text], field)[0]]


FILL = " and then the rest of the text goes on for quite a while with words that nobody would call a name, before anything comes back. "


def test_labels_agree_over_a_document(field):
    text = f"My name is Anber Closan.{FILL}We saw that Closan left.{FILL}The town of Marel is far.{FILL}{FILL}So did they and Anber too."
    got = found(text, field)
    assert ("person", "Anber Closan") in got and got.count(("person", "Closan")) == 1 and ("person", "Anber") in got and all("Marel" not in t for _, t in got)
    # the same places without the one that introduces the name
    assert found(text[text.index(" and then") :], field) == []
    text = f"Reach +1 (988) 555-2485 by day.{FILL}Or just 988-555-2485 at night.{FILL}Write to mo.lin42@mail.example.com soon.{FILL}That is mo.lin42 again.{FILL}Number 4111111111111111 or 4111.1111.1111.1111 now"
    got = found(text, field)
    assert [k for k, _ in got] == ["email", "card", "phone", "email_part", "card_part", "phone_part"]
    assert ("email_part", "mo.lin42") in got and ("phone_part", "988-555-2485") in got and ("card_part", "4111.1111.1111.1111") in got
    assert found(f"Order 9885552485 was sent.{FILL}See mo.lin42 and 4111.1111.1111.1112", field) == []


def test_held_out_texts(spark, field):
    """Stretches that weren't fitted: what is found is right, and most of what was written is found."""
    texts = [r["text"][-2000:] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect() if r["text"]]
    right = wrong = missed = 0
    for i, text in enumerate(texts):
        made, truth = pii.written(text, 10_000 + i)
        want = {p for p in truth}
        cover = {c for s, e in want for c in range(s, e)}
        spans = [(s, e) for k, s, e in pii.spans_of([made], field)[0] if k >= len(pii.BASE)]
        right += sum(s in cover and e - 1 in cover for s, e in spans)
        wrong += sum(not (s in cover and e - 1 in cover) for s, e in spans)
        missed += sum(not any(a <= s and e <= b for a, b in spans) for s, e in want)
    assert wrong <= 0.03 * right and missed <= 0.2 * (right + missed), (right, wrong, missed)


def test_clean_documents_stay_clean(spark, field):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert sum(k >= len(pii.BASE) for spans in pii.spans_of(texts, field) for k, _, _ in spans) == 0


def test_messages_equal_enumeration_on_a_chain():
    """On a graph without loops the messages give exact marginals."""
    rng = np.random.default_rng(0)
    features = pii.Features()
    features([f"f{i}" for i in range(4)])
    field = pii.Field(features)
    field.nodes[:] = rng.normal(size=field.nodes.shape)
    field.pairs[:] = rng.normal(size=field.pairs.shape)
    graph = pii.Graph([[0], [1], [2], [3]], [-1, 2, -1, -1], [(0, 1, 0), (1, 2, 1), (2, 3, 2)], [(0, 0, 1)] * 4, [0] * 4)
    p, both = field.marginals(graph, rounds=60)
    total = np.zeros((4, 6))
    whole = 0.0
    for x in np.ndindex(6, 6, 6, 6):
        if x[1] != 2:
            continue
        w = np.exp(sum(field.nodes[i, x[i]] for i in (0, 2, 3)) + sum(field.pairs[k][x[a], x[b]] for a, b, k in graph.edges))
        whole += w
        for i in range(4):
            total[i, x[i]] += w
    assert np.abs(p - total / whole).max() < 1e-9 and np.abs(both.sum((1, 2)) - 1).max() < 1e-12


def test_query_and_odd_rows(spark, field):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op11_personal_data(spark, SF).collect():
        base = brute(texts[r["doc_id"]])
        shown = ",".join(f"{pii.BASE[k]}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest() and [r[f"n_{k}"] for k in pii.BASE] == [sum(k == b[0] for b in base) for k in range(4)]
        assert r["spans"].startswith(shown)
    long = "é🙂 " * 100_000 + "a@b.cd"
    rows = [(1, None, "x"), (None, "", "y"), (1, "a@b.cd", None), (2, long, "z"), (2, long, "z")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string")
    got = sorted((r["doc_id"] or 0, len(r["text"] or ""), [tuple(s) for s in r["pii_spans"]]) for r in pii.find_personal(odd, field).collect())
    mail = ("email", 0, 6)
    assert got == [(0, 0, []), (1, 0, []), (1, 6, [mail]), (2, 300_006, [("email", 300_000, 300_006)]), (2, 300_006, [("email", 300_000, 300_006)])]
    clean = sorted(((r["doc_id"] or 0, (r["text"] or "")[-8:], r["pii_spans"]) for r in pii.redact(odd, field).collect()), key=repr)
    assert clean == sorted([(1, "", "x"), (0, "", "y"), (1, "[email]", None), (2, " [email]", "z"), (2, " [email]", "z")], key=repr)
    assert pii.redact(odd, field).filter("doc_id = 1 AND pii_spans = 'x'").first()["text"] is None
    nothing = pii.train(odd.limit(0))
    assert pii.find_personal(odd.limit(0), nothing).count() == 0 and found("a@b.cd Mr. Smith", nothing) == [("email", "a@b.cd")]
