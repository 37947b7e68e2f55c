"""A task queue as a table: enqueue, lease, complete, fail, and recover.

Every function maps a queue table to a new one; time is always a parameter.
Spark has no row locks, so one writer advances the queue and hands out leases.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEASE_SECONDS, RETRY_SECONDS, MAX_ATTEMPTS, ERROR_CHARS = 300, 300, 5, 1024


def _after(now: Column, seconds: int) -> Column:
    return now + F.make_dt_interval(secs=F.lit(seconds))


def enqueue(queue: DataFrame, tasks: DataFrame, now: Column, policy: str = "keep") -> DataFrame:
    """Queue with the tasks (task_id, task_type, payload, available_at), one row per id.

    ``keep``: a task in progress stays so, a completed or failed one is pending
    again, attempts are kept.  ``reset``: every task is pending again, attempts
    of completed and failed ones start anew.
    """
    one = F.row_number().over(W.partitionBy("task_id").orderBy(F.asc_nulls_first("available_at")))
    t = tasks.withColumn("_n", one).filter("_n = 1").select("task_id", F.col("task_type").alias("n_type"), F.col("payload").alias("n_payload"), F.coalesce("available_at", now).alias("n_at"), F.lit(True).alias("_new"))
    j = queue.join(t, "task_id", "full")
    new, old = F.coalesce("_new", F.lit(False)), F.col("status").isNotNull()
    ended = F.col("status").isin("completed", "failed")
    if policy == "keep":
        status = F.when(~old | ended, "pending").otherwise(F.col("status"))
        attempts = F.coalesce("attempts", F.lit(0))
    elif policy == "reset":
        status = F.lit("pending")
        attempts = F.when(~old | ended, 0).otherwise(F.col("attempts"))
    else:
        raise ValueError(f"unknown policy {policy}")
    touched = {
        "task_type": F.coalesce("n_type", "task_type"), "status": status, "payload": F.coalesce("n_payload", "payload"), "attempts": attempts, "available_at": F.col("n_at"),
        "locked_at": F.when(status == "pending", None).otherwise(F.col("locked_at")), "last_error": F.when(ended, None).otherwise(F.col("last_error")),
        "created_at": F.coalesce("created_at", now), "updated_at": now,
    }
    return j.select("task_id", *(F.when(new, v).otherwise(F.col(k)).alias(k) for k, v in touched.items())).select(*queue.columns)


def eligible(queue: DataFrame, now: Column, task_types: list[str] | None = None, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """Tasks that are due, or whose lease has run out."""
    due = (F.col("status") == "pending") & (F.col("available_at") <= now)
    stale = (F.col("status") == "in_progress") & (F.col("locked_at") <= _after(now, -lease_seconds))
    q = queue.filter(due | stale)
    return q.filter(F.col("task_type").isin(task_types)) if task_types else q


def fetch_and_lock(queue: DataFrame, now: Column, task_types: list[str] | None = None, lease_seconds: int = LEASE_SECONDS, most: int = 1) -> tuple[DataFrame, DataFrame]:
    """(the oldest eligible tasks, ``most`` at most; the queue with their leases)."""
    head = eligible(queue, now, task_types, lease_seconds).orderBy("available_at", "created_at", "task_id").limit(most)
    head = head.withColumn("status", F.lit("in_progress")).withColumn("locked_at", now).withColumn("updated_at", now)
    return head, queue.join(head.select("task_id"), "task_id", "left_anti").unionByName(head.select(*queue.columns))


def complete(queue: DataFrame, task_ids: list[str]) -> DataFrame:
    """Queue without the completed tasks."""
    return queue.filter(~F.col("task_id").isin(task_ids))


def fail(queue: DataFrame, task_id: str, error: str, now: Column, retry_seconds: int = RETRY_SECONDS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """A failed attempt counted: pending again after a delay, or failed for good."""
    hit = F.col("task_id") == task_id
    tries = F.col("attempts") + 1
    done = tries >= max_attempts
    new = {
        "attempts": tries, "status": F.when(done, "failed").otherwise("pending"), "available_at": F.when(done, F.col("available_at")).otherwise(_after(now, retry_seconds)),
        "locked_at": F.lit(None).cast("timestamp"), "last_error": F.lit(error[:ERROR_CHARS]), "updated_at": now,
    }
    return queue.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in queue.columns))


def recover(queue: DataFrame, now: Column, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """Tasks with a lease that has run out made pending again."""
    stale = (F.col("status") == "in_progress") & (F.col("locked_at") <= _after(now, -lease_seconds))
    return queue.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "locked_at": F.when(stale, None).otherwise(F.col("locked_at"))})


def reschedule(queue: DataFrame, task_ids: list[str], at: Column, now: Column) -> DataFrame:
    """Tasks moved to another time."""
    hit = F.col("task_id").isin(task_ids)
    return queue.withColumn("available_at", F.when(hit, at).otherwise(F.col("available_at"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))


class QueueBackend(Protocol):
    """Where a queue is kept."""

    def load(self) -> DataFrame: ...

    def store(self, queue: DataFrame) -> None: ...


class TableBackend:
    """Queue as versioned Parquet folders on the cluster's file system.

    A task that is not due yet needs no promotion: ``eligible`` compares its time.
    """

    def __init__(self, spark, path: str):
        from knowloom.storage import Versions

        self._versions = Versions(spark, path, "task_queue")

    def load(self) -> DataFrame:
        return self._versions.load()

    def store(self, queue: DataFrame) -> None:
        self._versions.store(queue)


# Schemes of queue servers.
SERVICES = ("redis", "rediss", "unix")
#: Makers of backends by address scheme; a service's connector is registered here.
BACKENDS: dict[str, Callable] = {}


def open_backend(spark, target: str) -> QueueBackend:
    """Backend of an address: a registered service (``redis``, ``rediss``, ``unix``), a folder of any file system otherwise."""
    scheme = target.split("://", 1)[0] if "://" in target else ""
    if scheme in BACKENDS:
        return BACKENDS[scheme](spark, target)
    if scheme in SERVICES:
        raise ValueError(f"no queue connector is registered for {scheme}://")
    return TableBackend(spark, target)
