"""The stemmer on published examples, and the kept index against a scan."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.stem import stem, stems
from ledgerline.operators import search

# examples of the published rules
EXAMPLES = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun
activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


def test_published_examples(spark):
    pairs = dict(zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True))
    assert {w: stem(w) for w in pairs} == pairs
    assert [stem(w) for w in ("", "is", "naïve", "v2", "日本語")] == ["", "is", "naïve", "v2", "日本語"]
    rows = spark.createDataFrame([(w,) for w in pairs], "w string").select("w", stems(F.col("w")).alias("s"))
    assert {r["w"]: r["s"] for r in rows.collect()} == pairs


def brute(docs, query, form):
    clauses, without = search.parse_query(query)
    out = {}
    for i, text in docs:
        words = [form(w) for w in re.findall(r"[^\W_]+", (text or "").lower())]
        has = lambda alt, words=words: any(words[k : k + len(alt)] == [form(w) for w in alt] for k in range(len(words)))
        if all(any(map(has, c)) for c in clauses) and not any(map(has, without)):
            n = Counter(words)
            out[i] = round(sum(math.log1p(n[w]) for w in {form(w) for c in clauses for alt in c for w in alt}), 9)
    return out


@pytest.mark.parametrize("stemmed", [True, False])
def test_index_equals_a_scan(spark, tmp_path, stemmed):
    rng = random.Random(3)
    bits = "connect connected connecting connection connections apply applies applied role roles of the hiring hired Interview interviews é 42".split()
    docs = [(i, " ".join(rng.choices(bits, k=rng.randrange(12)))) for i in range(300)] + [(900, None), (901, ""), (902, "the " * 5000 + "roles")]
    index = search.TextIndex.build(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", str(tmp_path))
    for query in ("connecting", '"the roles" -hired', "applied OR interview role", '"connection of" OR "hires the"', "absent", "the", "-the role", ""):
        got = {r["id"]: round(r["rank"], 9) for r in index.search(query, stemmed).collect()}
        want = brute(docs, query, stem if stemmed else (lambda w: w)) if query else {}
        assert got == want, query


def test_a_query_reads_the_parts_of_its_words(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} other{i % 7}") for i in range(200)], "doc_id long, text string")
    index = search.TextIndex.build(docs, "doc_id", "text", str(tmp_path))
    plan = index.search("word5", stemmed=False)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_an_index_shuffles_texts_and_not_their_words(spark, tmp_path, monkeypatch):
    def shuffled():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        none = sc._jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    monkeypatch.setattr(search, "TASK_CHARS", 2000, raising=False)
    docs = spark.createDataFrame([(i, "some words and others " * 20) for i in range(100)], "doc_id long, text string")
    before = shuffled()
    index = search.TextIndex.build(docs, "doc_id", "text", str(tmp_path))
    assert shuffled() - before < 200
    assert {(r["id"], r["rank"] > 0) for r in index.search('"words and" -absent', stemmed=False).collect()} == {(i, True) for i in range(100)}
    assert len(list(tmp_path.glob("postings/part=*/*.parquet"))) > 40
