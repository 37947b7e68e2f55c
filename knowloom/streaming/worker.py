"""The worker: stages in order over a queue, in batches or as a stream."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowloom.functions.ids import task_id
from knowloom.operators import task_queue as tq
from knowloom.session import materialise

log = logging.getLogger(__name__)

Handler = Callable[[dict], list[tuple[str, dict]]]
#: What each kind of task leads to when it has succeeded.
FOLLOW_UPS = {"semantic_index": ["entity_extract"], "entity_extract": ["lab_results", "financial_records", "medical_events"], "lab_results": [], "financial_records": [], "medical_events": []}


def follow_ups(task_type: str, payload: dict, extractors: dict[str, str]) -> list[tuple[str, dict]]:
    """Tasks after one: extraction after indexing, the three fact builders after extraction, each with its extractor."""
    out = []
    for kind in FOLLOW_UPS.get(task_type, []):
        p = {"content_id": payload.get("content_id")}
        if kind in extractors:
            p["extractor"] = extractors[kind]
        out.append((kind, p))
    return out


class Worker:
    """Leases due tasks, runs their handlers, and enqueues what follows.

    A handler returns the tasks that follow; an exception counts as a failed
    attempt.  The worker is the queue's only writer.  It writes the queue twice for
    a lease of up to ``lease`` tasks: when they are locked, and when all their
    results, follow-ups included, are known; a crash in between leaves leases that
    run out, and no task is lost.
    """

    def __init__(self, spark, backend: tq.QueueBackend, handlers: dict[str, Handler], clock: Callable[[], str], lease: int = 1):
        self.spark, self.backend, self.handlers, self.clock, self.lease = spark, backend, handlers, clock, lease

    def _enqueued(self, queue: DataFrame, tasks: list[tuple[str, dict]]) -> DataFrame:
        if not tasks:
            return queue
        rows = [(task_id(k, p), k, json.dumps(p, sort_keys=True), None) for k, p in tasks]
        df = self.spark.createDataFrame(rows, "task_id string, task_type string, payload string, available_at timestamp")
        return tq.enqueue(queue, df, self._now())

    def enqueue(self, tasks: list[tuple[str, dict]]) -> None:
        if tasks:
            self.backend.store(self._enqueued(self.backend.load(), tasks))

    def _now(self):
        return F.lit(self.clock()).cast("timestamp")

    def step(self) -> int:
        """One lease; returns the number of its tasks."""
        now = self._now()
        head, queue = tq.fetch_and_lock(self.backend.load(), now, list(self.handlers), most=self.lease)
        rows = materialise(head).collect()
        if not rows:
            return 0
        locked = self.spark.createDataFrame(rows, head.schema)
        self.backend.store(queue.join(locked.select("task_id"), "task_id", "left_anti").unionByName(locked.select(*queue.columns)))
        done, failed, after = [], {}, []
        for row in rows:
            try:
                after += self.handlers[row["task_type"]](json.loads(row["payload"])) or []
                done.append(row["task_id"])
            except Exception as e:
                log.exception("task %s failed", row["task_id"])
                failed[row["task_id"]] = str(e)
        queue = tq.complete(self.backend.load(), done)
        for one, error in failed.items():
            queue = tq.fail(queue, one, error, now)
        self.backend.store(self._enqueued(queue, after))
        return len(rows)

    def run(self, once: bool = True, most: int | None = None, wait: Callable[[], None] = lambda: None) -> int:
        """Work until nothing is due (``once``) or ``most`` tasks are done; returns their number."""
        done = 0
        while most is None or done < most:
            n = self.step()
            done += n
            if not n:
                if once:
                    break
                wait()
        return done


def ingest_stream(inbound: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Messages of a stream handed batch by batch to ``process``; with ``available_now`` the stream ends when all are read.

    ``process`` should merge by key, as a batch may come again after a failure.
    """
    w = inbound.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")).start()


def queue_state_stream(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Latest event of every task in a stream of (task_id, status, ts): the queue's state without a scan of its history."""
    return events.withWatermark("ts", watermark).groupBy("task_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("updated_at"))
