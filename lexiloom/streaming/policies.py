"""Request policies over a log of events: token buckets, daily budgets, an expiring least-recently-used cache.

Batch forms fold each client's events in order; the streaming forms of the token bucket and of the budgets with refunds keep the
same state between micro-batches, and give the same decisions. Budgets that only look at one client or at one day are window
functions. What couples all clients (a global budget behind client limits, a shared cache) is one ordered group by
nature: ``admitted`` solves it by counting, ``cached`` folds keys apart, since expiry needs no other key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PER_MINUTE, PER_CLIENT, PER_DAY, TTL_SECONDS = 20, 60, 200, 86_400
BUCKET = "event_id long, client string, at double, allowed boolean, retry_after int, tokens double"


def step(tokens: float, updated: float, at: float, per_minute: int) -> tuple[float, bool, int]:
    """One request of a bucket: tokens left, whether it is admitted, seconds to wait if not. A clock that goes back
    refills nothing."""
    rate = per_minute / 60.0
    tokens = min(float(per_minute), tokens + max(0.0, at - updated) * rate)
    if tokens >= 1.0:
        return tokens - 1.0, True, 0
    return tokens, False, max(1, int((1.0 - tokens) / rate) + 1)


def _folded(frame: pd.DataFrame, tokens: float, updated: float | None, per_minute: int) -> tuple[pd.DataFrame, float, float]:
    out = []
    for r in frame.sort_values(["at", "event_id"], kind="stable").itertuples():
        tokens, ok, wait = step(tokens, r.at if updated is None else updated, r.at, per_minute)
        updated = r.at
        out.append((r.event_id, r.client, r.at, ok, wait, tokens))
    return pd.DataFrame(out, columns=[c.split()[0] for c in BUCKET.split(", ")]).astype({"retry_after": "int32"}), tokens, updated or 0.0


def in_order(events: DataFrame, key: str, fold: Callable, schema: str, types: dict[str, pa.DataType], more: tuple[str, ...] = ()) -> DataFrame:
    """(event_id, key, at, more) and what ``fold(state, at, event_id, *more)`` gives for each event, a tuple of the new state and the
    columns of ``types``; the first event of a key has the state None. A fold that takes only (state, at) gets no more.

    Keys are dealt to tasks, and a task reads its events in order of key, time and event: all it holds is a batch of rows
    and the state of one key, however many events a key has. A null key is a key like any other.
    """
    takes = fold.__code__.co_argcount if hasattr(fold, "__code__") else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            out: list[list] = [[] for _ in types]
            ids, keys, *rest = (c.to_pylist() for c in batch.columns)
            for i, k, at, *others in zip(ids, keys, *rest, strict=True):
                if not begun or k != now:
                    now, state, begun = k, None, True
                state, found = fold(state, at) if takes == 2 else fold(state, at, i, *others)
                for column, value in zip(out, found, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(out, types.values(), strict=True))], ["event_id", key, "at", *more, *types])

    rows = events.select(F.col("event_id").cast("long").alias("event_id"), F.col(key).cast("string").alias(key), F.col("at").cast("double").alias("at"), *[F.col(c).cast("string").alias(c) for c in more])
    return rows.repartition(F.col(key)).sortWithinPartitions(key, "at", "event_id").mapInArrow(run, schema)


def token_bucket(events: DataFrame, per_minute: int = PER_MINUTE) -> DataFrame:
    """events (event_id, client, at seconds) with the bucket's decision for each; 0 a minute admits all."""
    if per_minute <= 0:
        return events.select(F.col("event_id").cast("long").alias("event_id"), F.col("client").cast("string").alias("client"), F.col("at").cast("double").alias("at"), F.lit(True).alias("allowed"), F.lit(0).alias("retry_after"), F.lit(0.0).alias("tokens"))

    def fold(state: tuple[float, float] | None, at: float) -> tuple[tuple[float, float], tuple]:
        tokens, updated = state or (float(per_minute), at)
        tokens, ok, wait = step(tokens, updated, at, per_minute)
        return (tokens, at), (ok, wait, tokens)

    return in_order(events, "client", fold, BUCKET, {"allowed": pa.bool_(), "retry_after": pa.int32(), "tokens": pa.float64()})


def token_bucket_stream(events: DataFrame, per_minute: int = PER_MINUTE) -> DataFrame:
    """The same over a stream: a client's tokens and clock are the state; events of a micro-batch are taken in order."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, updated = state.get if state.exists else (float(per_minute), None)
        out, tokens, updated = _folded(pd.concat(list(frames)), tokens, updated, per_minute)
        state.update((tokens, updated))
        yield out

    return events.groupBy("client").applyInPandasWithState(run, BUCKET, "tokens double, updated double", "append", GroupStateTimeout.NoTimeout)


def admitted(events: DataFrame, per_client: int = PER_CLIENT, per_day: int = PER_DAY) -> DataFrame:
    """events (event_id, client, day, at) with ``reason``: null if admitted, client_daily or global_daily if not.

    A refused request consumes nothing. While the day's budget lasts, a client's n-th request of the day is within its
    limit iff n <= per_client; so the first per_day of those, in order, are admitted. After that the client limit still
    names itself first: a client's admitted requests of the day are those among the first per_day. Days are dealt to
    tasks; within a day only the requests within their clients' limits are put in order, in parts whose counts are
    added up.
    """
    mine = W.partitionBy("day", "client").orderBy("at", "event_id")
    numbered = events.withColumn("_nth", F.row_number().over(mine))
    within = numbered.where(F.col("_nth") <= per_client)
    hours = within.groupBy("day", F.floor(F.col("at") / 60).alias("_minute")).agg(F.count("*").alias("_n"))
    before = hours.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("day").orderBy("_minute").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col("day").alias("_day"), F.col("_minute").alias("_of"), "_before")
    place = F.row_number().over(W.partitionBy("day", F.floor(F.col("at") / 60)).orderBy("at", "event_id"))
    placed = within.withColumn("_place", place).join(before, (F.col("day") == F.col("_day")) & (F.floor(F.col("at") / 60) == F.col("_of")))
    first = placed.where(F.col("_place") + F.col("_before") <= per_day).select(F.col("event_id").alias("_id"), F.lit(True).alias("_in"))
    joined = numbered.join(first, F.col("event_id") == F.col("_id"), "left")
    used = F.count(F.col("_in")).over(mine.rowsBetween(W.unboundedPreceding, -1))
    reason = F.when(F.col("_in").isNotNull(), F.lit(None).cast("string")).when(used >= per_client, "client_daily").otherwise("global_daily")
    return joined.select(*events.columns, reason.alias("reason"))


class Allowances:
    """What a day has used, and each of its clients: of more than ``tracked`` clients the one that was admitted longest ago is
    forgotten, and starts anew."""

    def __init__(self, per_client: int, per_day: int, tracked: int, total: int = 0, used: dict[str, int] | None = None) -> None:
        self.per_client, self.per_day, self.tracked, self.total, self.used = per_client, per_day, tracked, total, used or {}

    def decide(self, client: str, kind: str) -> str | None:
        """Null if a request is admitted, else why not. A refund gives one request back to its client and the day, never below zero."""
        mine = self.used.get(client, 0)
        if kind == "refund":
            self.total -= self.total > 0
            if mine:
                self.used[client] = mine - 1
            return None
        if mine >= self.per_client:
            return "client_daily"
        if self.total >= self.per_day:
            return "global_daily"
        self.used.pop(client, None)
        self.used[client] = mine + 1
        self.total += 1
        if len(self.used) > self.tracked:
            del self.used[next(iter(self.used))]
        return None


_DECIDED = "event_id long, day string, at double, client string, kind string, reason string"


def admitted_with_refunds(events: DataFrame, per_client: int = PER_CLIENT, per_day: int = PER_DAY, tracked: int = 4096) -> DataFrame:
    """events (event_id, client, day, at, kind: request or refund) with ``reason`` as in ``admitted``, null for a refund, and
    ``repeated`` for an event that comes again with its time, which changes nothing. Refunds couple all requests of a day, so a
    day is read in order, a batch of rows at a time; what is held of it is the allowances of ``tracked`` clients."""

    def fold(state: tuple[Allowances, int] | None, at: float, event: int, client: str, kind: str) -> tuple[tuple[Allowances, int], tuple[str | None]]:
        held, last = state or (Allowances(per_client, per_day, tracked), None)
        reason = "repeated" if event == last else held.decide(client, kind)
        return (held, event), (reason,)

    return in_order(events, "day", fold, _DECIDED, {"reason": pa.string()}, ("client", "kind"))


def admitted_stream(events: DataFrame, per_client: int = PER_CLIENT, per_day: int = PER_DAY, tracked: int = 4096, delay: str = "10 minutes") -> DataFrame:
    """The same over a stream of events that have ``ts``, the time of ``at``, too: requests wait until the watermark, ``delay``
    behind the latest event, has passed them, and are then decided in order of time, so events that come late but within the delay, or again,
    are decided as the batch decides them. What comes later still, Spark drops: it gets no row and changes nothing.

    A day's clients, waiting events and seen events are map states, and a timer clears them when the watermark has left the
    day. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Budgets(StatefulProcessor):
        def init(self, handle) -> None:  # noqa: ANN001
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "event_id long", "client string, at double, kind string")
            self.seen = handle.getMapState("seen", "event_id long", "at double")
            self.used = handle.getMapState("used", "client string", "n int, nth long")
            self.total = handle.getValueState("total", "n long, nth long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
            out, latest = [], None
            for frame in rows:
                for r in frame.itertuples():
                    if self.seen.containsKey((r.event_id,)):
                        out.append((r.event_id, key[0], r.at, r.client, r.kind, "repeated"))
                        continue
                    self.seen.updateValue((r.event_id,), (r.at,))
                    self.waiting.updateValue((r.event_id,), (r.client, r.at, r.kind))
                    latest = max(r.at, latest or r.at)
            if latest is not None:
                self.handle.registerTimer(int(latest * 1000) + 1)
                self.handle.registerTimer(self._end(key[0]))
            yield self._frame(out)

        @staticmethod
        def _end(day: str) -> int:
            """A day after the day's end: no event of it can be in time any more."""
            return int((pd.Timestamp(day, tz="UTC") + pd.Timedelta(days=2)).timestamp() * 1000)

        @staticmethod
        def _frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=[c.split()[0] for c in _DECIDED.split(", ")])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
            passed = timerValues.getCurrentWatermarkInMs() / 1000.0
            due = sorted((v[1], k[0], v[0], v[2]) for k, v in self.waiting.iterator() if v[1] < passed)
            counts = self.total.get() or (0, 0)
            before = {k[0]: v for k, v in self.used.iterator()}
            held = Allowances(per_client, per_day, tracked, counts[0], {c: v[0] for c, v in sorted(before.items(), key=lambda x: x[1][1])})
            out, last, nth = [], {}, counts[1]
            for at, event, client, kind in due:
                admitted, reason = held.total, held.decide(client, kind)
                nth += 1
                if held.total > admitted:
                    last[client] = nth
                out.append((event, key[0], at, client, kind, reason))
                self.waiting.removeKey((event,))
            for client, n in held.used.items():
                new = (n, last.get(client, before[client][1] if client in before else nth))
                if before.get(client) != new:
                    self.used.updateValue((client,), new)
            for client in before:
                if client not in held.used:
                    self.used.removeKey((client,))
            self.total.update((held.total, nth))
            if expiredTimerInfo.getExpiryTimeInMs() >= self._end(key[0]):
                for state in (self.waiting, self.seen, self.used, self.total):
                    state.clear()
            yield self._frame(out)

        def close(self) -> None:
            pass

    rows = events.select("event_id", F.col("client").cast("string").alias("client"), F.col("day").cast("string").alias("day"), F.col("at").cast("double").alias("at"), "kind", "ts").withWatermark("ts", delay)
    return rows.groupBy("day").transformWithStateInPandas(statefulProcessor=Budgets(), outputStructType=_DECIDED, outputMode="append", timeMode="EventTime")


def cached(events: DataFrame, ttl: float = TTL_SECONDS) -> DataFrame:
    """events (event_id, key, at) with ``hit``: whether an answer younger than ttl was stored for the key; a miss stores
    one. No capacity limit: for that, ``cached_in_order``."""

    def fold(stored: float | None, at: float) -> tuple[float, tuple[bool]]:
        hit = stored is not None and at - stored < ttl
        return (stored if hit else at), (hit,)

    return in_order(events, "key", fold, "event_id long, key string, at double, hit boolean", {"hit": pa.bool_()})


def cached_in_order(events: DataFrame, capacity: int = 512, ttl: float = TTL_SECONDS, shard: str = "shard") -> DataFrame:
    """As ``cached`` with a capacity, the least recently used going first: one ordered fold for each shard (a server of its
    own cache), a column of events; of a shard its ``capacity`` keys are held, and a batch of rows."""

    def fold(stored: dict[str, float] | None, at: float, event: int, key: str) -> tuple[dict[str, float], tuple[bool]]:
        stored = {} if stored is None else stored
        since = stored.pop(key, None)
        hit = since is not None and at - since < ttl
        stored[key] = since if hit else at
        if len(stored) > capacity:
            del stored[next(iter(stored))]
        return stored, (hit,)

    return in_order(events, shard, fold, f"event_id long, {shard} string, at double, key string, hit boolean", {"hit": pa.bool_()}, ("key",)).select("event_id", "key", "at", "hit")


def snapshot(decisions: DataFrame, day: str, per_day: int = PER_DAY) -> DataFrame:
    """(day, used, remaining) of a day's admitted requests; a day without any has used nothing."""
    return decisions.agg(F.count_if((F.col("day") == day) & F.col("reason").isNull()).alias("used")).select(F.lit(day).alias("day"), "used", (F.lit(per_day) - F.col("used")).alias("remaining"))
