"""Structured Streaming: incremental scans, recurrence, per-host throttling, event windows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glint.functions import columns as C
from glint.operators import detect

# What a refusal adds to a host's delay, what an answer takes off, and the most, in seconds.
PENALTY, REWARD, MOST_DELAY = 0.5, 0.25, 5.0


def scan_stream(assets: DataFrame, text: str = "body") -> DataFrame:
    """Findings of a stream of assets; narrow, so it runs in append mode without state."""
    d = detect.detect_values(assets, text)
    return d.withColumn("fingerprint", C.fingerprint(F.col("kind"), F.col("source_url"), F.col("value"))).withColumn("value", C.mask(F.col("value"))).drop(text)


def first_seen(findings: DataFrame, time: str, within: str = "1 day") -> DataFrame:
    """Each fingerprint once within the watermark; state is dropped behind it."""
    return findings.withWatermark(time, within).dropDuplicatesWithinWatermark(["fingerprint"])


def throttle(responses: DataFrame) -> DataFrame:
    """host, delay after each batch: refusals (429, 503) raise a host's delay, answers lower it; at 0 it is forgotten."""

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        delay = state.get[0] if state.exists else 0.0
        for p in parts:
            for code in p.sort_values("ts")["status_code"]:
                delay = min(delay + PENALTY, MOST_DELAY) if code in (429, 503) else max(delay - REWARD, 0.0)
        state.update((delay,)) if delay > 0 else state.remove()
        yield pd.DataFrame({"host": [key[0]], "delay": [delay]})

    return responses.groupBy("host").applyInPandasWithState(step, "host string, delay double", "delay double", "update", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.withWatermark("ts", late) if d.isStreaming else d
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    d = d.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return d.select(F.col("w.start").cast("timestamp_ntz").alias("starts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.withWatermark("ts", late) if d.isStreaming else d
    d = d.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return d.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("starts"), F.col("w.end").cast("timestamp_ntz").alias("ends"), "n")
