"""First-seen lookups with a time to live anchored at the stored answer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from earthframe.streaming.admission import with_bursts

OUT = "key string, event_id bigint, ts timestamp, action string"


def lookup_key(service: Column, query: Column) -> Column:
    """Case- and whitespace-insensitive, and scoped to the service asked."""
    return F.concat(service, F.lit("|"), F.trim(F.regexp_replace(F.lower(query), r"\s+", " ")))


def decide(stored: float | None, now: float, ok: bool, ttl: float) -> tuple[str, float | None]:
    """(action, stored time): a hit never refreshes; a failed resolve stores nothing."""
    if stored is not None and now - stored <= ttl:
        return "hit", stored
    return ("resolve", now) if ok else ("failed", None)


def first_seen_batch(lookups: DataFrame, ttl: float) -> DataFrame:
    """Action per lookup (key, event_id, ts, ok), streamed in time order.

    Nothing outlives a ttl without lookups, so a key is divided at such gaps.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stored = None, None
        for batch in batches:
            actions = []
            for key, burst, micros, ok in zip(
                    batch["key"], batch["burst"], batch["_us"], batch["ok"]):
                if (key, burst) != current:
                    current, stored = (key, burst), None
                action, stored = decide(stored, micros / 1e6, ok, ttl)
                actions.append(action)
            yield batch[["key", "event_id", "ts"]].assign(action=actions)

    typed = lookups.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts"), "ok")
    keyed = with_bursts(typed, ttl, "key").withColumn("_us", F.unix_micros("ts"))
    return keyed.repartition("key", "burst").sortWithinPartitions(
        "key", "burst", "_us", "event_id").mapInPandas(run, OUT)


def first_seen_stream(lookups: DataFrame, ttl: float, watermark: str | None = None) -> DataFrame:
    """The same over a stream; state is one stored time per key, dropped after its ttl.

    Lookups may come as late as the ttl is long, or as late as ``watermark`` says.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
            ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        actions = []
        for second, ok in zip(rows["ts"].astype("datetime64[us]").astype("int64") / 1e6, rows["ok"]):
            action, stored = decide(stored, second, ok, ttl)
            actions.append(action)
        if stored is None:
            if state.exists:
                state.remove()
        else:
            state.update((stored,))
            state.setTimeoutTimestamp(
                max(int((stored + ttl) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        out = rows[["event_id", "ts"]].assign(action=actions)
        out.insert(0, "key", key[0])
        yield out

    source = lookups.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts"), "ok")
    return source.withWatermark("ts", watermark or f"{int(ttl)} seconds").groupBy("key").applyInPandasWithState(
        run, OUT, "stored double", "append", GroupStateTimeout.EventTimeTimeout)
