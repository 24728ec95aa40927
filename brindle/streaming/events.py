"""Status and limit streams (R01-R03, R06, W03, W04, W10, A10). The batch forms serve queries over stored events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_status(events: DataFrame, *, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last event of each key; a streaming frame gives a streaming aggregate (update mode). Ties go to the larger row."""
    last = events.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("x"), F.count(F.lit(1)).alias("n_events"))
    return last.select(key, F.col(f"x.{order}").alias(order), *[F.col(f"x.{c}").alias(c) for c in columns], "n_events")


def batch_progress(items: DataFrame, *, batch: str = "batch_id", status: str = "status", position: str = "position") -> DataFrame:
    """Items, done, errors, percent done (one digit) and the current position of each batch."""
    s = F.col(status)
    first = lambda name: F.min(F.when(s == name, F.col(position)))
    counted = items.groupBy(batch).agg(F.count(F.lit(1)).alias("items"), F.count_if(s.isin("COMPLETED", "DRAFT", "ERROR", "REJECTED")).alias("done"), F.count_if(s.isin("ERROR", "REJECTED")).alias("errors"), F.coalesce(first("PROCESSING"), first("QUEUED")).alias("current"))
    return counted.withColumn("percent", F.round(F.col("done") * 100.0 / F.col("items"), 1))


def resumed(log: DataFrame, after_id: int, id: str = "id") -> DataFrame:
    """Entries after the last one that a reader has seen."""
    return log.where(F.col(id) > after_id)


def tail(log: DataFrame, n: int = 500, id: str = "id") -> DataFrame:
    """The newest n entries in order; a ring buffer's report."""
    return log.orderBy(F.desc(id)).limit(n).orderBy(id)


def sliding_count(events: DataFrame, *, key: str, time: str, seconds: int = 60) -> DataFrame:
    """W03, count only: events of the key in the `seconds` up to each event, itself and the border included. A key's
    events are split by time, each span with a copy of the one before it, so no key is read in one task."""
    moment = F.unix_micros(F.col(time).cast("timestamp"))
    span = F.floor(F.col("__t") / F.lit(seconds * 1_000_000))
    dealt = events.withColumn("__t", moment).withColumn("__own", span).withColumn("__span", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    w = Window.partitionBy(key, "__span").orderBy("__t").rangeBetween(-seconds * 1_000_000, 0)
    return dealt.withColumn("in_window", F.count(F.lit(1)).over(w)).where(F.col("__span").eqNullSafe(F.col("__own"))).drop("__t", "__own", "__span")


def limited(events: DataFrame, *, key: str, time: str, limit: int, seconds: float, schema: str) -> DataFrame:
    """W03, W04 over stored events: adds allowed and retry_after. A rejected event isn't counted later; an event expires
    when it is `seconds` old. schema: of the events and the two columns. Each key's events are read in time order, one
    Arrow batch at a time, with `limit` times kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[object, list[float]] = {}
        last = object()
        for f in frames:
            allowed, retry = [], []
            seconds_of = (f[time] - pd.Timestamp(0, tz=f[time].dt.tz)).dt.total_seconds()
            for k, t in zip(f[key], seconds_of, strict=True):
                if k != last:
                    kept = {k: []}
                    last = k
                own = [x for x in kept[k] if t - x < seconds]
                ok = len(own) < limit
                retry.append(0 if ok else max(1, int(seconds - (t - own[0]))))
                allowed.append(ok)
                if ok:
                    own.append(t)
                kept[k] = own
            yield f.assign(allowed=allowed, retry_after=retry)

    return events.repartition(key).sortWithinPartitions(key, time).mapInPandas(run, schema)


def limited_stream(events: DataFrame, *, key: str, time: str, limit: int, seconds: float, delay: str = "10 minutes") -> DataFrame:
    """W03, W04 on a stream: key, time and allowed of each event. State is the times of at most `limit` events a key; it
    goes when the watermark has passed the window. A batch's rows of a key are put in time order first."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(name, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(time)
        allowed = []
        for t in rows[time].map(lambda x: x.timestamp()):
            own = [x for x in own if t - x < seconds]
            allowed.append(len(own) < limit)
            if allowed[-1]:
                own.append(t)
        state.update((own,))
        state.setTimeoutTimestamp(max(int((own[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: rows[key].to_numpy(), time: rows[time].to_numpy(), "allowed": allowed})

    kind = dict(events.dtypes)[key]
    dealt = events.withWatermark(time, delay).groupBy(key)
    return dealt.applyInPandasWithState(step, f"{key} {kind}, {time} timestamp, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def deduplicated(events: DataFrame, *, id: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """R03, R06 on a stream: each id once while the watermark keeps it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([id])


def windowed_counts(events: DataFrame, *, time: str, by: list[str], width: str = "1 hour", delay: str | None = "1 hour") -> DataFrame:
    """Counts in event-time windows with a watermark for late rows; delay None keeps the watermark that the stream has."""
    source = events.withWatermark(time, delay) if events.isStreaming and delay else events
    counted = source.groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n")
