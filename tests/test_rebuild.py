"""Threads by headers against a search, snapshots that are whole or not there, and dates without a zone."""

import random

import pytest

from ledgerline.operators import rebuild
from ledgerline.sources import envelopes as env
from ledgerline.streaming.versions import Versions


@pytest.mark.parametrize("seed", range(3))
def test_threads_equal_a_search(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(80):
        refs = [f"<m{rng.randrange(100)}@x>" for _ in range(rng.choice([0, 0, 1, 3]))]
        rows.append((f"k{i:02}", None if i % 17 == 0 else f"<m{i if i % 13 else 26}@x>", rng.choice([None, "", f"<m{rng.randrange(100)}@x>"]), refs or None, "Hello"))
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for key, own, parent, refs, _ in rows:
        me = own or f"#{key}"
        root(me)
        for other in [parent, *(refs or [])]:
            if other:
                a, b = sorted((root(me), root(other)))
                top[b] = a
    mail = spark.createDataFrame(rows, "storage_key string, message_id_header string, in_reply_to string, references_ids array<string>, subject string")
    got = {r["storage_key"]: r["thread_id"] for r in rebuild.thread_roots(mail).collect()}
    assert got == {key: root(own or f"#{key}") for key, own, *_ in rows}


def test_readers_keep_the_old_snapshot_until_the_new_one_is_whole(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    v.replace(0, {"t": (spark.createDataFrame([("a", 1)], "key string, n long"), ["key"])})
    spark.createDataFrame([("a", 2)], "key string, n long").write.parquet(f"{tmp_path}/t/000000001")  # a rebuild that ended early
    assert v.latest() == 0 and v.read("t", v.latest(), "key string, n long").first()["n"] == 1
    v.replace(1, {"t": (spark.createDataFrame([("b", 3)], "key string, n long"), ["key"])})
    assert [tuple(r) for r in v.read("t", v.latest(), "key string, n long").collect()] == [("b", 3)]


def test_dates_without_a_zone_are_utc(spark):
    rows = []
    for i, zone in enumerate(["", " -0000", " +0200", " GMT", " nonsense"]):
        payload = f"From: a@x.example\r\nTo: me@own.example\r\nSubject: s\r\nMessage-ID: <{i}@x>\r\nDate: Mon, 02 Jan 2023 10:00:00{zone}\r\n\r\nhi"
        rows.append((f"k{i}", "me@own.example", None, bytearray(payload.encode())))
    mail = spark.createDataFrame(rows, "storage_key string, account string, fetched_at timestamp, payload binary")
    held = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = {r["storage_key"]: r["t"] for r in env.parse_messages(mail).selectExpr("storage_key", "unix_timestamp(sent_at) AS t").collect()}
            assert [got[f"k{i}"] for i in range(4)] == [1672653600, 1672653600, 1672653600 - 7200, 1672653600], (zone, got)
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)
