"""The stateful operators: a pending queue with a time limit and a processing-state machine, for batch and stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor

# The limits of the queue and the states of processing.
TTL = "12 hours"
MOST = 50
STATES = ["idle", "downloading", "indexing", "ready", "answering"]


def pending(events: DataFrame, user: str, ts: str, now: Column, ttl: str = TTL, most: int = MOST) -> DataFrame:
    """What is in each user's queue at `now`: not older than ttl, the newest `most`, drained in order of time (`place`)."""
    fresh = events.where((F.col(ts) <= now) & (F.col(ts) >= now - F.expr(f"INTERVAL {ttl}")))
    w = Window.partitionBy(user)
    kept = fresh.withColumn("_n", F.row_number().over(w.orderBy(F.desc(ts), F.desc("event_id")))).where(F.col("_n") <= most).drop("_n")
    return kept.withColumn("place", F.row_number().over(w.orderBy(ts, "event_id")))


def final_states(events: DataFrame, user: str, order: str, to: Column, allowed: dict[str, list[str]], start: str = "idle") -> DataFrame:
    """Each user's last state and number of accepted transitions; a transition that the state does not allow changes nothing.

    For finite allowed lists the step is a small map from state to state, and maps compose; so the
    fold over a user's ordered events is an aggregate of an array (a bounded history per user).
    """
    steps = events.groupBy(user).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), to.alias("to")))), lambda x: x["to"]).alias("steps"))
    table = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def step(s, x):
        good = F.coalesce(F.array_contains(F.element_at(table, x), s["state"]), F.lit(False))
        return F.struct(F.when(good, x).otherwise(s["state"]).alias("state"), (s["accepted"] + F.when(good, 1).otherwise(0)).alias("accepted"))

    begin = F.struct(F.lit(start).alias("state"), F.lit(0).alias("accepted"))
    return steps.select(user, F.aggregate("steps", begin, step).alias("s")).select(user, "s.state", "s.accepted")


def stream_states(events: DataFrame, allowed: dict[str, list[str]], start: str = "idle") -> DataFrame:
    """The same machine over a stream of (user_id, event_id, to): emits user_id, state, accepted after each batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, accepted = state.get if state.exists else (start, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for to in rows["to"]:
            if now in allowed.get(to, []):
                now, accepted = to, accepted + 1
        state.update((now, int(accepted)))
        yield pd.DataFrame({"user_id": [key[0]], "state": [now], "accepted": [int(accepted)]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, state string, accepted long", "state string, accepted long", "update", "NoTimeout")


def waiting(events: DataFrame, now: Column, ttl: str = TTL, most: int = MOST) -> DataFrame:
    """What is in each user's queue at `now`, if drains take all that came before them: events have user_id, event_id, ts and kind (enqueue or drain).

    A drain takes what has its moment or an earlier one. The rest is as in pending().
    """
    drained = events.where("kind = 'drain'").groupBy("user_id").agg(F.max("ts").alias("_drained"))
    left = events.where("kind = 'enqueue'").join(drained, "user_id", "left").where("_drained IS NULL OR ts > _drained").drop("_drained")
    return pending(left, "user_id", "ts", now, ttl, most)


def _queue_processor(ttl_micros: int, most: int) -> StatefulProcessor:
    columns = ["user_id", "event_id", "at", "text", "status", "place"]

    class Queue(StatefulProcessor):  # made here, so that it travels as it is
        """One user's queue: the newest entries since the last drain, and that drain's moment. A timer wakes it when its oldest entry is too old."""

        def init(self, handle) -> None:
            self.handle = handle
            self.items = handle.getListState("items", "at long, event_id long, text string")
            self.drained = handle.getValueState("drained", "at long")

        def told(self, key, taken: list[tuple], held: list[tuple]) -> pd.DataFrame:
            """Stores the queue and says what was drained and what is queued; a user without entries is told too, so that what was told before ends."""
            if held:
                self.items.put(held)
                self.handle.registerTimer(held[0][0] // 1000 + 1)
            else:
                self.items.clear()
            out = [(key[0], i[1], i[0], i[2], status, k) for status, rows in (("drained", taken), ("queued", held)) for k, i in enumerate(rows, 1)]
            return pd.DataFrame(out or [(key[0], None, None, None, "empty", 0)], columns=columns).astype({"event_id": "Int64", "at": "Int64"})

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            before = self.drained.get()[0] if self.drained.exists() else None
            held, drains, taken = [tuple(i) for i in self.items.get()], [], []
            for frame in rows:
                for r in frame.itertuples(index=False):
                    if r.kind == "drain":
                        drains.append(int(r.at))
                    elif r.kind == "enqueue":
                        entry = (int(r.at), int(r.event_id), None if pd.isna(r.text) else r.text)
                        # what came before a drain that is past is handed on at once
                        (taken if before is not None and entry[0] <= before else held).append(entry)
            held.sort(key=lambda i: i[:2])
            for drain in sorted(d for d in drains if before is None or d > before):
                due = [i for i in held if i[0] <= drain]
                held = held[len(due) :]
                taken += [i for i in due if i[0] >= drain - ttl_micros][-most:]
                before = drain
            if before is not None:
                self.drained.update((before,))
            # what is too old by now goes here too, as a timer of the same batch would tell the queue once more
            late = timerValues.getCurrentWatermarkInMs() * 1000
            yield self.told(key, taken, [i for i in held if i[0] >= late][-most:])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            late = timerValues.getCurrentWatermarkInMs() * 1000
            before = [tuple(i) for i in self.items.get()]
            held = [i for i in before if i[0] >= late]
            if len(held) < len(before):
                yield self.told(key, [], held)

        def close(self) -> None:
            pass

    return Queue()


def stream_queue(events: DataFrame, ttl_seconds: int = 12 * 3600, most: int = MOST) -> DataFrame:
    """The queues of a stream of (user_id, event_id, ts, kind, text), after each batch for the users whose queue it touches.

    Rows are user_id, event_id, at (microseconds), text, status and place: queued are all entries of
    the user's queue now, drained those that the batch's drains took, empty a user without entries.
    What is queued equals waiting() over all events so far, whatever the order they come in: events
    older than the time limit (and a second) before the newest are too old for the queue and are left
    out by the watermark, and entries that grow too old are taken out by timers. An entry that comes
    after a drain later than it is handed on as drained at once. State is bounded: `most` entries a
    user. The session needs the state store that keyed_state() sets.
    """
    seen = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "kind", "text").withWatermark("ts", f"{ttl_seconds + 1} seconds")
    rows = seen.withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("user_id").transformWithStateInPandas(_queue_processor(ttl_seconds * 1_000_000, most), "user_id long, event_id long, at long, text string, status string, place int", "Update", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession):
    """Within it, streams that are started keep their state in a store that can hold lists and time limits."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_pending_counts(events: DataFrame, ttl: str = TTL, every: str = "1 hour") -> DataFrame:
    """Queue lengths of a stream by window of event time; late rows beyond the limit are dropped by the watermark."""
    return events.withWatermark("ts", ttl).groupBy(F.window("ts", every), "user_id").agg(F.count("*").alias("n"))


def access_until(redemptions: DataFrame, user: str, at: str, days: Column) -> DataFrame:
    """Each user's access end (seconds) after redemptions in order: the later of end and moment, plus the duration."""
    rows = running_access(redemptions.withColumn("_at", F.col(at).cast("bigint")).withColumn("_plus", (days * 86400).cast("bigint")), user, "_at", "_plus")
    return rows.groupBy(user).agg(F.max_by("until", F.struct("_at", "event_id")).alias("until"), F.count("*").cast("int").alias("redeemed"))


def running_access(redemptions: DataFrame, user: str, at: str, plus: str) -> DataFrame:
    """Adds until: the access end after each redemption (user, event_id, moment and duration in seconds) of a user.

    Each sets the end to the later of end and moment, plus its duration. Written out, the end is the sum
    of all durations so far plus the largest of (moment less the durations before it), so that two
    running windows give it and no user's history is held together.
    """
    w = Window.partitionBy(user).orderBy(at, "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = redemptions.withColumn("_sum", F.sum(plus).over(w))
    return summed.withColumn("until", F.col("_sum") + F.max(F.col(at) - (F.col("_sum") - F.col(plus))).over(w)).drop("_sum")


#: Fixed value: the form of a code.
CODE = "^[A-Z0-9]{4}(?:-[A-Z0-9]{4}){2}$"


def redeemed(attempts: DataFrame, codes: DataFrame) -> DataFrame:
    """attempts (user_id, event_id, code, at) with code as it counts, verdict and until (seconds, of accepted ones).

    codes: code, duration (seconds), most (redemptions), revoked and expires_at (null: never), one row
    a code. The first reason counts: form, unknown, revoked, expired, used; else the attempt is accepted.
    Of attempts at a code those that nothing else speaks against are counted in order of (at, event_id).
    """
    held = attempts.withColumn("code", F.upper(F.trim(F.coalesce("code", F.lit("")))))
    joined = held.join(codes.withColumn("_known", F.lit(True)), "code", "left")
    reason = F.when(~F.col("code").rlike(CODE), "form").when(F.col("_known").isNull(), "unknown").when(F.coalesce("revoked", F.lit(False)), "revoked").when(F.col("at") >= F.col("expires_at"), "expired")
    judged = joined.withColumn("verdict", reason)
    turn = F.row_number().over(Window.partitionBy("code", F.col("verdict").isNull()).orderBy("at", "event_id"))
    judged = judged.withColumn("verdict", F.when(F.col("verdict").isNotNull(), F.col("verdict")).when(turn > F.col("most"), "used").otherwise("accepted")).select(*attempts.columns, "verdict", "duration")
    good = running_access(judged.where("verdict = 'accepted'"), "user_id", "at", "duration").drop("duration")
    return good.unionByName(judged.where("verdict <> 'accepted'").drop("duration").withColumn("until", F.lit(None).cast("long")))
