"""Run events as JSON lines: append, and the latest ones."""

from __future__ import annotations

import json
import os
import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_event(path: str, event: str, **fields) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps({"timestamp": datetime.now(timezone.utc).isoformat(), "event": event, **fields}, ensure_ascii=False, default=str) + "\n")


@contextmanager
def timed(path: str, event: str, **fields) -> Iterator[None]:
    """Log how long a block took and the driver's peak memory."""
    began = time.perf_counter()
    try:
        yield
    finally:
        log_event(path, event, seconds=round(time.perf_counter() - began, 3), peak_rss_mb=round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1), **fields)


def recent_events(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """(timestamp, event, fields MAP): the latest events; lines that aren't JSON objects are left out."""
    rows = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m")).where("m IS NOT NULL AND m['event'] IS NOT NULL")
    rows = rows.select(F.col("m")["timestamp"].alias("timestamp"), F.col("m")["event"].alias("event"), F.map_filter("m", lambda k, v: ~k.isin("timestamp", "event")).alias("fields"))
    return rows.orderBy(F.desc("timestamp")).limit(limit)
