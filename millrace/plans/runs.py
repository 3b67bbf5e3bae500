"""A table of runs that several sweeps share: every point is claimed by one of them.

A run is named by its cache hash.  Its n-th attempt is claimed by a file that can be made only once, and ends by
another, which holds the state (COMPLETED, PARTIAL or FAILED), the means, and the counts of queries.  An attempt
without an end is RUNNING; one whose claim is older than ``patience`` seconds is given up, so that a sweep that died
doesn't block the point.  ``table`` reads all attempts as a DataFrame, for ``relational.cached_runs`` and
``relational.plan_status``.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import create_once

_ROW = "cache_hash string, attempt int, kind string, status string, at double, means map<string,double>, error string, queries int, completed int, failed int"


@dataclass(frozen=True)
class Attempt:
    """The latest attempt of a run; number 0 if there is none."""

    number: int = 0
    status: str = "NONE"
    began: float = 0.0
    record: dict = field(default_factory=dict)


class RunTable:
    """The runs below a folder that all sweeps can reach."""

    def __init__(self, spark: SparkSession, root: str, patience: float = 6 * 3600.0):
        self.spark, self.root, self.patience = spark, root.rstrip("/"), patience

    def _file(self, key: str, number: int, kind: str) -> str:
        return f"{self.root}/{key}/{number:06d}-{kind}.json"

    def _put(self, key: str, number: int, kind: str, **row) -> bool:
        data = json.dumps({"cache_hash": key, "attempt": number, "kind": kind, "at": time.time(), **row})
        return create_once(self.spark, self._file(key, number, kind), data.encode() + b"\n")

    def _read(self, path: str) -> dict | None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(conf)
        if not files.exists(target):
            return None
        stream = files.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self, key: str) -> Attempt:
        """The last attempt that was claimed."""
        number, claim = 0, None
        while (found := self._read(self._file(key, number + 1, "claim"))) is not None:
            number, claim = number + 1, found
        if claim is None:
            return Attempt()
        end = self._read(self._file(key, number, "end"))
        return Attempt(number, end["status"] if end else "RUNNING", claim["at"], end or {})

    def claim(self, key: str, again: bool = False) -> int | None:
        """The number of a new attempt, which is the caller's alone; None if a run is completed or under way.

        ``again`` starts an attempt beside a completed one.
        """
        last = self.latest(key)
        if last.status == "RUNNING":
            if time.time() - last.began <= self.patience:
                return None
            self.finish(key, last.number, "FAILED", error="given up")
        elif last.status == "COMPLETED" and not again:
            return None
        number = last.number + 1
        return number if self._put(key, number, "claim") else None

    def finish(self, key: str, number: int, status: str, means: dict | None = None, error: str = "", queries: int = 0, completed: int = 0, failed: int = 0) -> bool:
        """End an attempt; False if it has been given up meanwhile."""
        return self._put(key, number, "end", status=status, means=means or {}, error=error, queries=queries, completed=completed, failed=failed)

    def wait(self, key: str, poll: float = 0.2) -> Attempt:
        """The latest attempt, once it isn't under way any more."""
        while (last := self.latest(key)).status == "RUNNING" and time.time() - last.began <= self.patience:
            time.sleep(poll)
        return last

    def table(self) -> DataFrame:
        """Every attempt: run_id, cache_hash, attempt, status, started_at, completed_at, means, error and counts."""
        events = self.spark.read.schema(_ROW).json(f"{self.root}/*/*.json")
        claims = events.where("kind = 'claim'").select("cache_hash", "attempt", F.col("at").cast("timestamp").alias("started_at"))
        ends = events.where("kind = 'end'").select("cache_hash", "attempt", "status", F.col("at").cast("timestamp").alias("completed_at"), "means", "error", "queries", "completed", "failed")
        both = claims.join(ends, ["cache_hash", "attempt"], "left")
        return both.withColumns({"run_id": F.concat_ws("-", "cache_hash", "attempt"), "status": F.coalesce("status", F.lit("RUNNING"))})
