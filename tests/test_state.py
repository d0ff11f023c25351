"""Applications under mail in any order, segments of companies, and timers of silence."""

import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline import storage
from ledgerline.operators import resolve, upkeep
from ledgerline.plans import intake, registry
from ledgerline.plans.adapters import record
from ledgerline.streaming import state
from tests.test_folds import brute_assign

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
MENTIONS = "company_id long, id string, role string, at timestamp_ntz, ends boolean"


def made(n, seed, companies=3, days=4):
    rng = random.Random(seed)
    roles = [None, None, "", "Data Engineer", "Senior Data Engineer", "Platform Engineer", "engineer", "Data Platform Lead", "the", "Sales", "Sales Lead EMEA"]
    at, rows = T0, []
    for i in range(n):
        at += timedelta(days=rng.choice([0, 1, days, 60 if rng.random() < 0.2 else 2]))
        rows.append((rng.randrange(companies), f"{i:05}", rng.choice(roles), at, rng.random() < 0.3))
    return rows


def brute(rows):
    return brute_assign([(i, c, role or None, at, ends) for c, i, role, at, ends in rows])


@pytest.mark.parametrize("seed", range(4))
def test_index_equals_a_walk_over_all(seed):
    rows = made(400, seed)
    got = {}
    for company in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == company]
        out = resolve.Applications().add(pd.DataFrame(own, columns=["company_id", "id", "role", "at", "ends"]))
        got |= {i: (c, a) for i, c, a in out.itertuples(index=False)}
    assert got == brute(rows)


def test_time_follows_the_mentions_of_one_company():
    """Every mention opens an application that never ends, of a role of its own; nothing is walked over."""
    def seconds(n):
        rows = pd.DataFrame([(1, f"{i:06}", f"Engineer of thing{i} and place{i % 997}", T0 + timedelta(hours=i), i % 5 == 0) for i in range(n)], columns=["company_id", "id", "role", "at", "ends"])
        began = time.process_time()
        assert resolve.Applications().add(rows)["application"].nunique() > n * 0.9
        return time.process_time() - began

    small, large = seconds(10_000), seconds(100_000)
    assert large < 25 * small and large < 60


@pytest.mark.parametrize("seed", range(3))
def test_segments_change_nothing_and_cut_companies(spark, seed):
    rng = random.Random(seed)
    rows = made(200, seed, days=10) + [(7, f"q{i:04}", "Lead", T0 + timedelta(days=20 * i + rng.randrange(3)), i % 5 == 4) for i in range(100)] + [(8, f"r{i:04}", ["a b", None][i % 2], T0 + timedelta(days=50 * i), True) for i in range(50)]
    # a block of one role whose last mention ends, then silence
    rows += [(9, f"s{i:04}", "Lead", T0 + timedelta(days=100 * (i // 4) + i % 4), i % 4 == 3) for i in range(80)]
    df = spark.createDataFrame(rows, MENTIONS)
    got = {x["id"]: (x["company_id"], x["application"]) for x in resolve.assign_applications(df).collect()}
    assert got == brute(rows)
    parts = {(x["company_id"], x["segment"]) for x in resolve.cut_mentions(df).select("company_id", "segment").distinct().collect()}
    assert sum(c == 9 for c, _ in parts) == 20 and sum(c == 8 for c, _ in parts) == 50


def follow(spark, folder, batches, lateness=None):
    df = spark.createDataFrame([r for b in batches for r in b], MENTIONS)
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, MENTIONS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
        out = state.append_batches(f"{folder}/said{k}")
        state.run_keyed(state.follow_applications(stream, lateness), out, f"{folder}/check").awaitTermination()
    said = None
    for k in range(len(batches)):
        part = spark.read.schema(f"{state.FOLLOWED}, batch int").parquet(f"{folder}/said{k}")
        said = part if said is None else said.unionByName(part)
    return df, said


def test_any_order_over_many_batches_ends_as_the_batch_fold(spark, tmp_path):
    rows = made(150, 11, companies=2)
    rng = random.Random(1)
    shuffled = rng.sample(rows, len(rows))
    batches = [shuffled[i::6] for i in range(6)]
    _, said = follow(spark, tmp_path, batches)
    got = {x["id"]: (x["company_id"], x["application"]) for x in state.settled_applications(said).collect()}
    assert got == brute(rows) and said.filter("late").count() == 0
    assert said.count() > len(rows)  # some were said anew when earlier mail arrived


def test_late_mail_and_bounded_state(spark, tmp_path):
    rows = made(240, 12, companies=2)
    ordered = sorted(rows, key=lambda r: r[3])
    late = ordered[40:44]
    ordered = [r for r in ordered if r not in late]
    # within a batch and between neighbours the order is loose; four mentions come at the very end
    batches = [ordered[:100], [*ordered[130:150], *ordered[100:130]], ordered[150:], late]
    df, said = follow(spark, tmp_path, batches, lateness=200)
    assert {x["id"] for x in said.filter("late").collect()} == {r[1] for r in late}
    got = {x["id"]: (x["company_id"], x["application"]) for x in state.settled_applications(said, df).collect()}
    assert got == brute(rows)
    # those whose company got no late mail are right without a fold of everything, and the rest were right before it came
    before = [r for r in rows if r not in late]
    early = {x["id"]: (x["company_id"], x["application"]) for x in state.settled_applications(said.filter(~F.col("late") & (F.col("id").isin(*[r[1] for r in before])))).collect()}
    assert early == brute(before)
    held = spark.read.format("statestore").option("stateVarName", "recent").load(f"{tmp_path}/check").count()
    assert held < 120


def test_registered_streams_equal_the_fold(spark):
    r = record(spark, SF)
    rows = intake.mentions_of_mail(r).collect()
    got = {x["id"]: (x["company_id"], x["application"]) for x in registry.QUERIES["stream_applications_late"](spark, SF).collect()}
    assert got == brute(rows)


def test_silences_at_every_step_of_the_clock(spark, tmp_path):
    """After each batch the stream has said what the batch query says at that time, and nothing twice."""
    r = record(spark, SF)
    ends = r.stage_event.filter("stage IN ('rejected', 'withdrawn', 'accepted', 'declined')").select(F.col("evidence_message_id").alias("id")).distinct().withColumn("ends", F.lit(True))
    rows = r.message.filter("application_id % 3 = 0").select("application_id", "id", F.col("sent_at").cast("timestamp").alias("sent_at"), "direction").join(ends, "id", "left").fillna(False, ["ends"]).orderBy("sent_at", "id").toPandas()
    schema = "application_id long, id string, sent_at timestamp, direction string, ends boolean"
    rows = rows[["application_id", "id", "sent_at", "direction", "ends"]]
    n, said = len(rows), []
    cuts = [0, n // 5, n // 3, n // 3 + 3, n // 2, n]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        spark.createDataFrame(rows.iloc[a:b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = f"{tmp_path}/said{k}"
        state.run_keyed(state.watch_silences(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), state.append_batches(out), f"{tmp_path}/check", "append").awaitTermination()
        said += [tuple(x) for x in spark.read.schema(f"{state.SILENT}, batch int").parquet(out).select("application_id", "state", "since").collect()]
        assert len(said) == len(set(said))
        seen = rows.iloc[:b].sort_values(["sent_at", "id"])
        clock = seen["sent_at"].max()
        want = set()
        for app, own in seen.groupby("application_id"):
            own = list(own.itertuples(index=False))
            done = False
            for i, m in enumerate(own):
                done = done or m.ends
                until = own[i + 1].sent_at if i + 1 < len(own) else clock
                for what, days in (("going_cold", 14), ("ghosted", 21)):
                    if m.direction == "outbound" and not done and m.sent_at + pd.Timedelta(days=days) < until:
                        want.add((app, what, (m.sent_at + pd.Timedelta(days=days)).to_pydatetime()))
        assert {(a, s, t) for a, s, t in said} == want
    assert len(said) > 10
    now = {(x["application_id"], x["state"], x["since"]) for x in upkeep.silences(r, at=rows["sent_at"].max().to_pydatetime()).filter("application_id % 3 = 0").collect()}
    last = rows.sort_values(["sent_at", "id"]).groupby("application_id").last()
    assert {(a, s, t) for a, s, t in said if last.loc[a, "sent_at"] < t} >= {x for x in now if not rows[rows.application_id == x[0]]["ends"].any()}


def test_a_part_in_many_files_is_one_batch(spark):
    rows = spark.range(0, 4000, 1, 4).withColumn("part", F.col("id") % 5)
    seen = []

    def start(stream):
        marked = stream.withColumn("file", F.input_file_name())
        folder = f"{seen[0] if seen else seen.append(storage.shared_dir(spark)) or seen[0]}/check"
        see = lambda batch, number: seen.append((number, [x[0] for x in batch.select("part").distinct().collect()], batch.count(), batch.select("file").distinct().count()))
        return marked.writeStream.option("checkpointLocation", folder).foreachBatch(see).trigger(availableNow=True).start()

    intake._arriving(rows.filter("part <> 3"), 5, F.col("part"), start)
    assert [x[:3] for x in seen[1:]] == [(n, [k], 800) for n, k in enumerate((0, 1, 2, 4))] and all(x[3] == 4 for x in seen[1:])


def _silences(spark, folder, batches):
    """What folding in batches says after each batch, as sets of the batch's own."""
    schema, seen = "application_id long, id string, sent_at timestamp, direction string, ends boolean", []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        state.silences_in_batches(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/watched", f"{folder}/check").awaitTermination()
        said = [tuple(x) for x in state.silences_said(spark, f"{folder}/watched").collect()]
        assert len(said) == len(set(said))
        seen.append({(a, what, (at - T0).days) for a, what, at in said} - (set().union(*seen) if seen else set()))
    return seen


def test_silences_in_batches_follow_the_clock_and_late_endings(spark, tmp_path):
    day = lambda n: T0 + timedelta(days=n)
    got = _silences(spark, tmp_path, [
        [(1, "a", day(0), "outbound", False), (2, "b", day(0), "outbound", False), (3, "c", day(0), "inbound", False), (4, "d", day(1), "outbound", True), (5, "e", day(0), "outbound", False), (6, "f", day(10), "outbound", False)],
        # the clock passes a first step of 1, 2 and 5; 6 is answered in time
        [(3, "g", day(15), "outbound", False), (6, "h", day(20), "inbound", False)],
        # an ending that comes late stops 1, an older message doesn't stop 2, an answer proves 5
        [(1, "i", day(-3), "inbound", True), (2, "j", day(-2), "inbound", False), (5, "k", day(22), "outbound", False)],
        [(9, "l", day(60), "inbound", False)],
    ])
    assert got[0] == set() and got[1] == {(a, "going_cold", 14) for a in (1, 2, 5)}
    assert got[2] == {(2, "ghosted", 21), (5, "ghosted", 21)}
    assert got[3] == {(3, "going_cold", 29), (3, "ghosted", 36), (5, "going_cold", 36), (5, "ghosted", 43)}


def test_silences_take_jobs_by_the_batch_and_no_calls_by_the_key(spark, monkeypatch):
    """The registered stream had Python calls for each application of each batch."""
    called = []
    monkeypatch.setattr(state, "watch_silences", lambda *a, **k: called.append(a))
    assert registry.QUERIES["stream_silences"](spark, SF).count() > 0 and not called


def test_following_in_batches_equals_the_fold_and_tells_late_mail(spark, tmp_path, monkeypatch):
    rows = sorted(made(240, 12, companies=2), key=lambda r: r[3])
    late = rows[40:44]
    ordered = [r for r in rows if r not in late]
    batches = [ordered[:100], [*ordered[130:150], *ordered[100:130]], ordered[150:], late]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, MENTIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        state.follow_in_batches(spark.readStream.schema(spark.createDataFrame([], MENTIONS).schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/folded", f"{tmp_path}/check", 200).awaitTermination()
        held = spark.read.schema(state.FOLDED).parquet(f"{tmp_path}/folded/batch={k}").filter("kind = 2").count()
        assert held < 120
    said = state.said_in_batches(spark, f"{tmp_path}/folded")
    assert {x["id"] for x in said.filter("late").collect()} == {r[1] for r in late}
    got = {x["id"]: (x["company_id"], x["application"]) for x in state.settled_applications(said, spark.createDataFrame(rows, MENTIONS)).collect()}
    assert got == brute(rows)
    called = []
    monkeypatch.setattr(state, "follow_applications", lambda *a, **k: called.append(a))
    assert registry.QUERIES["stream_applications_late"](spark, SF).count() > 0 and not called
