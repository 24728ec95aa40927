"""Retention, catalogues, queues and capacity as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expired(entries: DataFrame, now: Column, days: int, *, name: str = "name", modified: str = "modified", pattern: str = r"^[A-Za-z0-9_-]{1,80}$") -> DataFrame:
    """Entries whose name is one of ours and that were last changed more than `days` days before now."""
    return entries.where(F.col(name).rlike(pattern) & (F.col(modified).cast("timestamp") < now - F.make_dt_interval(F.lit(days))))


def adapter_target(base_model: Column) -> Column:
    """Which model an adapter is for, by the name of its base."""
    name = F.lower(base_model)
    return F.when(F.contains(name, F.lit("qwen")), F.lit("qwen")).when(F.contains(name, F.lit("florence")), F.lit("florence")).otherwise(F.lit("unknown"))


def catalogue(models: DataFrame, active_path: str, *, path: str = "path", fmt: str = "format") -> DataFrame:
    """Each path once (its last source counts), marked active and selectable: the active one first, then by
    source and name whatever their case."""
    once = models.groupBy(path).agg(F.max_by(F.struct(*[c for c in models.columns if c != path]), "position").alias("__m"))
    marked = once.select(path, "__m.*").withColumns({"active": F.col(path) == active_path, "selectable": F.col(fmt) == "OpenVINO"})
    return marked.orderBy(~F.col("active"), F.lower("source"), F.lower("name"))


def _first(rows: DataFrame, order: list, n: int, column: str) -> DataFrame:
    """The first n rows in order, marked true; n is a capacity's overflow."""
    few = rows.orderBy(*order).limit(max(0, n)).select(column)
    return few.withColumn("__first", F.lit(True))


def pruned_queues(queues: DataFrame, now: float, *, ttl: float = 300.0, most: int = 100, session: str = "session_id") -> DataFrame:
    """The sessions whose queue goes so that one more fits: first those completed `ttl` seconds ago or longer, then
    the oldest by completion or creation; never one that is read or active. created_at, completed_at: seconds;
    consumed, active: flags."""
    idle = ~F.col("consumed") & ~F.col("active")
    gone = queues.where(idle & (now - F.col("completed_at") >= ttl)).select(session)
    left = queues.join(gone, session, "left_anti")
    overflow = left.count() - most + 1
    old = left.where(idle).withColumn("__at", F.coalesce("completed_at", "created_at"))
    return gone.union(_first(old, ["__at", session], overflow, session).select(session))


def evicted(batches: DataFrame, *, most: int = 50, batch: str = "batch_id") -> tuple[DataFrame, bool]:
    """The finished batches that go, in order of their id, until one more fits; and whether it does then."""
    overflow = batches.count() - most + 1
    gone = _first(batches.where("terminal"), [batch], overflow, batch).select(batch)
    return gone, overflow <= 0 or gone.count() == overflow


def delivered(entries: DataFrame, *, subscriber: str = "subscriber", order: str = "id", most: int = 250) -> DataFrame:
    """What is left in each subscriber's queue when the oldest entries give way: the last `most` of each."""
    w = Window.partitionBy(subscriber).orderBy(F.col(order).desc())
    return entries.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
