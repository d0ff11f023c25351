"""Keyed state over streams: applications that follow mail in any order, and timers of silence.

Each comes in two forms. ``follow_applications`` and ``watch_silences`` keep their state in Spark's store, key by key, which costs calls for every key that a batch
touches. ``follow_in_batches`` and ``silences_in_batches`` fold a batch as a whole with the table that the batch before it left: for large batches over many keys.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerline.operators.resolve import Application, Applications, assign_applications
from ledgerline.schemas import GHOSTED_AFTER

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that lists, maps and timers need; the session's own choice comes back afterwards."""
    held = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if held is None else spark.conf.set(_PROVIDER, held)


_EPOCH = datetime(1970, 1, 1)


def _micros(at: datetime) -> int:
    return (at - _EPOCH) // timedelta(microseconds=1)


def _time(micros: int) -> datetime:
    return _EPOCH + timedelta(microseconds=micros)


FOLLOWED = "company_id long, id string, application string, late boolean"


class FollowApplications(StatefulProcessor):
    """One company's applications, as its mentions arrive in whatever order.

    ``open`` has the applications that were near when everything up to ``base`` was folded, ``recent`` the mentions after it with
    what was said of them. New mentions are folded together with the recent ones, in order of time, from the base on, and what that
    says anew or otherwise is given out. The base follows the newest mention at the given distance (micros; none: it stays, and all mentions
    are kept): mentions that it passes leave the state, and of applications only near ones stay. One that arrives after the base has
    passed its time can't be folded here: it is given out as late, for the batch fold of its company.
    """

    def __init__(self, lateness: int | None) -> None:
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        # whole lists, read and written at once: an entry at a time costs a call each
        self.open = handle.getListState("open", "name string, start long, stop long, role string, nth int")
        self.recent = handle.getListState("recent", "at long, id string, role string, ends boolean, application string")
        self.mark = handle.getValueState("mark", "base long, opened int")

    def _fold(self, opened: int, based: bool) -> Applications:
        held = [Application(_time(start), None if stop is None else _time(stop), role, name, nth) for name, start, stop, role, nth in self.open.get()] if based else []
        return Applications(sorted(held, key=lambda a: a.order), opened)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        company = key[0]
        base, opened = self.mark.get() or (None, 0)
        known = {(at, name): (role, ends, said) for at, name, role, ends, said in self.recent.get()}
        out, fresh = [], False
        for r in rows:
            if base is not None and r.at < base:
                out.append(Row(company_id=company, id=r.id, application=None, late=True))
            else:
                known[r.at, r.id] = (r.role or None, bool(r.ends), None)
                fresh = True
        if not fresh:
            yield from out
            return
        top = max(at for at, _ in known)
        floor = None if self.lateness is None else max(top - self.lateness, base if base is not None else top - self.lateness)
        fold, moved, kept = self._fold(opened, base is not None), False, []
        for at, name in sorted(known):
            if floor is not None and at >= floor and not moved:
                self._settle(fold, floor)
                moved = True
            role, ends, said = known[at, name]
            now = fold.take(name, company, _time(at), role, ends)
            if now != said:
                out.append(Row(company_id=company, id=name, application=now, late=False))
            if floor is None or at >= floor:
                kept.append((at, name, role, ends, now))
        self.recent.put(kept)
        yield from out

    def _settle(self, fold: Applications, floor: int) -> None:
        """What is near at the base becomes the state's applications."""
        near = [(a.name, _micros(a.start), None if a.end is None else _micros(a.end), a.role, a.order) for a in fold.near() if a.end is None or _micros(a.end + Applications.SPAN) >= floor]
        self.open.put(near) if near else self.open.clear()
        self.mark.update((floor, fold.opened))

    def close(self) -> None:
        pass


_Mention = namedtuple("_Mention", "at id role ends")


def _mentions(rows: DataFrame) -> DataFrame:
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(at AS TIMESTAMP_NTZ))")
    return rows.filter("company_id IS NOT NULL").select("company_id", F.col("id").cast("string").alias("id"), "role", at.alias("at"), "ends")


def follow_applications(stream: DataFrame, lateness_days: int | None = None) -> DataFrame:
    """(company_id, id, application, late): what is said of mentions as they arrive; of what is said of a mention twice the later word counts.

    stream: company_id, id, role, at, ends. Mentions that are not further behind their company's newest one than ``lateness_days`` (none: any) end
    as the batch fold has them, in whatever order and batches they come; others come back as late.
    """
    lateness = None if lateness_days is None else lateness_days * 86_400_000_000
    return _mentions(stream).groupBy("company_id").transformWithState(statefulProcessor=FollowApplications(lateness), outputStructType=FOLLOWED, outputMode="Update", timeMode="None")


def run_keyed(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Start a stream with keyed state over what is there."""
    with keyed_state(stream.sparkSession):
        return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def append_batches(out: str) -> Callable[[DataFrame, int], None]:
    """Each batch into a folder of its own: one that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def fold_batches(stream: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], schema: str, root: str, checkpoint: str) -> StreamingQuery:
    """Each batch folded with the table that the batch before it wrote into a folder of its own; one that runs again sees what it saw and replaces what it wrote.

    fold: (batch, table before) -> table, of the given schema.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(schema).parquet(f"{root}/batch={number - 1}") if number else spark.createDataFrame([], schema)
        fold(batch, before).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


#: A batch's table of followed applications. Kinds: 0 a company's base (at) and how many it opened (nth), 1 an application that was near then, 2 a recent mention
#: with what was said of it, 3 what this batch says of a mention.
FOLDED = "company_id long, kind int, at long, id string, role string, ends boolean, stop long, nth int, application string, late boolean"
_FOLDED = [c.split()[0] for c in FOLDED.split(", ")]
_NEW = 4


class _Kept:
    """A state variable of one company, in memory."""

    def __init__(self, value) -> None:
        self.get, self.value = lambda: self.value, value

    def put(self, value) -> None:
        self.value = value

    update = put

    def clear(self) -> None:
        self.value = []


def _follow(lateness: int | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of companies, each whole, by kind, state before mentions: folded company by company as they stream by."""

    def company(key, held: list[tuple]) -> Iterator[tuple]:
        fold, mark, near, recent, fresh = FollowApplications(lateness), None, [], [], []
        for kind, at, name, role, ends, stop, nth, said in held:
            if kind == 0:
                mark = (at, nth)
            elif kind == 1:
                near.append((name, at, stop, role, nth))
            elif kind == 2:
                recent.append((at, name, role, ends, said))
            else:
                fresh.append(_Mention(at, name, role, ends))
        fold.open, fold.recent, fold.mark = _Kept(near), _Kept(recent), _Kept(mark)
        if fresh:
            for r in fold.handleInputRows((key,), iter(fresh), None):
                yield key, 3, None, r.id, None, None, None, None, r.application, r.late
        if fold.mark.value is not None:
            yield key, 0, fold.mark.value[0], None, None, None, None, fold.mark.value[1], None, None
        for name, start, stop, role, nth in fold.open.value:
            yield key, 1, start, name, role, None, stop, nth, None, None
        for at, name, role, ends, said in fold.recent.value:
            yield key, 2, at, name, role, ends, None, None, said, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        shape = lambda rows: pd.DataFrame(rows, columns=_FOLDED).astype({"at": "Int64", "stop": "Int64", "nth": "Int32"})
        for pdf in batches:
            columns = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in ("company_id", "kind", "at", "id", "role", "ends", "stop", "nth", "application")]
            for c, *rest in zip(*columns, strict=True):
                if c != key:
                    out += company(key, held) if held else ()
                    key, held = c, []
                    if len(out) >= 10_000:
                        yield shape(out)
                        out = []
                held.append((rest[0], None if rest[1] is None else int(rest[1]), rest[2], rest[3], rest[4], None if rest[5] is None else int(rest[5]), None if rest[6] is None else int(rest[6]), rest[7]))
        out += company(key, held) if held else ()
        if out:
            yield shape(out)

    return run


def follow_in_batches(stream: DataFrame, root: str, checkpoint: str, lateness_days: int | None = None) -> StreamingQuery:
    """What ``follow_applications`` says, for ``said_in_batches``: companies of a batch, and those that are held, pass through the tasks as sorted rows."""
    lateness = None if lateness_days is None else lateness_days * 86_400_000_000

    def fold(batch: DataFrame, before: DataFrame) -> DataFrame:
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        rows = _mentions(batch).select("company_id", F.lit(_NEW).alias("kind"), "at", "id", "role", "ends", none("long", "stop"), none("int", "nth"), none("string", "application"), none("boolean", "late"))
        held = before.filter("kind < 3").unionByName(rows)
        return held.repartition("company_id").sortWithinPartitions("company_id", "kind").mapInPandas(_follow(lateness), FOLDED)

    return fold_batches(stream, fold, FOLDED, root, checkpoint)


def said_in_batches(spark: SparkSession, root: str) -> DataFrame:
    """What ``follow_in_batches`` has said, with the number of its batch."""
    return spark.read.schema(f"{FOLDED}, batch int").parquet(root).filter("kind = 3").select("company_id", "id", "application", "late", "batch")


def settled_applications(said: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """(id, company_id, application) in the end: the last word on each mention; companies with late mentions are folded anew from all their mentions.

    said: what ``follow_applications`` gave, with the number of its batch; mentions: all that arrived, where late ones are possible.
    """
    last = said.groupBy("company_id", "id").agg(F.max_by(F.struct("application", "late"), "batch").alias("w")).select("id", "company_id", "w.application", "w.late")
    if mentions is None:
        return last.drop("late")
    again = said.filter("late").select("company_id").distinct()
    fine = last.join(again, "company_id", "left_anti").select("id", "company_id", "application")
    return fine.unionByName(assign_applications(mentions.join(again, "company_id", "left_semi")))


_SILENT = "application_id long, state string, since long"
#: What ``watch_silences`` gives.
SILENT = "application_id long, state string, since timestamp"


class WatchSilence(StatefulProcessor):
    """One application's newest message, and timers for what becomes of it if nobody answers.

    Steps are (state, days). A message that arrives after a step's time proves that silence lasted that long, also where the clock
    hadn't come round yet; one that arrives before it takes the timer back. After an ending nothing is watched. ``step`` is the next step
    that the newest message waits for, of which alone there is a timer; none: it doesn't wait, or all has been said.
    """

    def __init__(self, steps: tuple[tuple[str, int], ...]) -> None:
        self.steps = sorted(((days * 86_400_000_000, state) for state, days in steps))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, id string, ended boolean, step int")

    def _due(self, at: int | None, step: int | None) -> int | None:
        return None if step is None else at + self.steps[step][0]

    def _past(self, key, at: int, step: int | None, over: Callable[[int], bool]) -> tuple[list[Row], int | None]:
        """What is said of the steps that are over, and the next one."""
        said = []
        while step is not None and over(since := at + self.steps[step][0]):
            said.append(Row(application_id=key[0], state=self.steps[step][1], since=since))
            step = step + 1 if step + 1 < len(self.steps) else None
        return said, step

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, name, ended, step = self.last.get() or (None, None, False, None)
        held, said = self._due(at, step), []
        for now, i, direction, ends in sorted(((r.at, r.id, r.direction, bool(r.ends)) for r in rows), key=lambda r: r[:2]):
            ended = ended or ends
            if at is not None and (now, i) < (at, name):
                step = None if ended else step  # late: it is not the newest, whatever it says
                continue
            more, _ = self._past(key, at, step, lambda since: since < now)  # noqa: B023
            said += more
            at, name, step = now, i, 0 if direction == "outbound" and not ended else None
        due = self._due(at, step)
        if held != due:
            if held is not None:
                self.handle.deleteTimer(held // 1000 + 1)
            if due is not None:
                self.handle.registerTimer(due // 1000 + 1)
        self.last.update((at, name, ended, step))
        yield from said

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, name, ended, step = self.last.get()
        clock = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        said, step = self._past(key, at, step, lambda since: since // 1000 + 1 <= clock)
        if said:
            self.last.update((at, name, ended, step))
            if step is not None:
                self.handle.registerTimer(self._due(at, step) // 1000 + 1)
        yield from said

    def close(self) -> None:
        pass


def watch_silences(stream: DataFrame, delay: str = "0 seconds", cold_after: int = GHOSTED_AFTER - 7, ghosted_after: int = GHOSTED_AFTER) -> DataFrame:
    """(application_id, state, since): going_cold and ghosted, once for each outbound message that nobody answers for so long, as the clock of the stream passes.

    stream: application_id, id, sent_at, direction, ends. The clock is the newest message, less ``delay``.
    """
    rows = stream.select("application_id", "id", F.col("sent_at").cast("timestamp").alias("sent_at"), "direction", "ends").filter("application_id IS NOT NULL AND sent_at IS NOT NULL").withWatermark("sent_at", delay).withColumn("at", F.unix_micros("sent_at"))
    steps = (("going_cold", cold_after), ("ghosted", ghosted_after))
    said = rows.groupBy("application_id").transformWithState(statefulProcessor=WatchSilence(steps), outputStructType=_SILENT, outputMode="Append", timeMode="EventTime")
    return said.withColumn("since", F.timestamp_micros("since"))


#: A batch's table of silences: messages of the batch, and the newest one of each application, with what is said of it. Times in micros; step: the next step that it waits for.
WATCHED = "application_id long, id string, at long, ended boolean, step int, newest boolean, clock long, said array<struct<state: string, since: long>>"


def silences_in_batches(stream: DataFrame, root: str, checkpoint: str, delay: str = "0 seconds", cold_after: int = GHOSTED_AFTER - 7, ghosted_after: int = GHOSTED_AFTER) -> StreamingQuery:
    """What ``watch_silences`` says, for ``silences_said``: an application's newest message stands before those of a batch, and each says what passed until the next one,
    the last one what passed until the clock, which is the newest message of all, less ``delay``. Of mail behind an application's newest message only its ending counts.
    """
    steps = sorted((days * 86_400_000_000, state) for state, days in (("going_cold", cold_after), ("ghosted", ghosted_after)))
    behind = int(pd.Timedelta(delay).total_seconds() * 1_000_000)

    def fold(batch: DataFrame, before: DataFrame) -> DataFrame:
        rows = batch.filter("application_id IS NOT NULL AND sent_at IS NOT NULL").select(
            "application_id", "id", F.unix_micros(F.col("sent_at").cast("timestamp")).alias("at"), F.coalesce("ends", F.lit(False)).alias("ended"),
            F.when(F.col("direction") == "outbound", 0).alias("step"), F.lit(False).alias("held"),
        )
        newest = [x for x in (rows.agg(F.max("at")).first()[0], before.agg(F.max("clock") + behind).first()[0]) if x is not None]
        clock = F.lit(max(newest) - behind if newest else None).cast("long")
        own = Window.partitionBy("application_id").orderBy("at", "id", F.desc("held"))
        every = rows.unionByName(before.filter("newest").select("application_id", "id", "at", "ended", "step", F.lit(True).alias("held")))
        every = every.withColumn("late", F.coalesce(F.max("held").over(own.rowsBetween(1, Window.unboundedFollowing)), F.lit(False))).withColumn("next", F.lead("at").over(own))
        every = every.withColumn("ended", F.max("ended").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("step", F.when(~F.col("ended") & ~F.col("late"), F.col("step")))
        until = F.coalesce("next", clock)
        over = [(F.col("step") <= k) & (F.col("at") + F.lit(span) < until) for k, (span, _) in enumerate(steps)]
        said = F.array_compact(F.array(*[F.when(o, F.struct(F.lit(state).alias("state"), (F.col("at") + F.lit(span)).alias("since"))) for o, (span, state) in zip(over, steps, strict=True)]))
        step = F.coalesce(*[F.when((F.col("step") <= k) & ~o, k) for k, o in enumerate(over)])
        out = every.select("application_id", "id", "at", "ended", step.alias("step"), F.col("next").isNull().alias("newest"), clock.alias("clock"), said.alias("said"))
        return out.filter(F.col("newest") | (F.size("said") > 0))

    return fold_batches(stream, fold, WATCHED, root, checkpoint)


def silences_said(spark: SparkSession, root: str) -> DataFrame:
    """(application_id, state, since): what ``silences_in_batches`` has said."""
    said = spark.read.schema(f"{WATCHED}, batch int").parquet(root).select("application_id", F.explode("said").alias("s"))
    return said.select("application_id", "s.state", F.timestamp_micros("s.since").alias("since"))
