"""Traces of what a command did: steps with their status and time, one JSON line a command."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import SparkSession

SCHEMA = "trace_id string, command string, started string, steps array<struct<step:string,status:string,duration_ms:long,detail:string>>"


def trace_id(command: str, now: datetime | None = None) -> str:
    """The command, the time to the second and six characters by chance, so that ids sort by time and do not meet."""
    return f"{command}_{(now or datetime.now(timezone.utc)):%Y%m%dT%H%M%SZ}_{uuid.uuid4().hex[:6]}"


class Trace:
    """with Trace(spark, folder, "ingest") as t: with t.step("scan"): ... The line is appended at the end, also after an error."""

    def __init__(self, spark: SparkSession, folder: str, command: str, enabled: bool = True):
        self.spark, self.folder, self.command, self.enabled = spark, folder, command, enabled
        self.started = datetime.now(timezone.utc)
        self.id, self.steps = trace_id(command, self.started), []

    def __enter__(self) -> Trace:
        return self

    @contextmanager
    def step(self, name: str):
        began, note = time.perf_counter(), {"status": "ok", "detail": None}
        try:
            yield note  # the caller may set status to skipped, and a detail
        except BaseException as e:
            note.update(status="error", detail=f"{type(e).__name__}: {e}".splitlines()[0])
            raise
        finally:
            self.steps.append((name, note["status"], int(1000 * (time.perf_counter() - began)), note["detail"]))

    def __exit__(self, *_) -> None:
        if self.enabled:
            row = [(self.id, self.command, f"{self.started:%Y-%m-%dT%H:%M:%SZ}", self.steps)]
            self.spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").json(self.folder)
