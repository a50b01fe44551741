"""Sliding admission per client: only admitted hits count against the limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "client bigint, event_id bigint, ts timestamp, admitted boolean, retry_after double"


def admit_one(hits: deque, now: float, limit: int, window: float) -> tuple[bool, float | None]:
    """Admit or refuse one hit at ``now`` seconds; a hit exactly ``window`` old has aged out."""
    while hits and hits[0] <= now - window:
        hits.popleft()
    if len(hits) >= limit:
        return False, hits[0] + window - now
    hits.append(now)
    return True, None


def with_bursts(events: DataFrame, window: float, key: str = "client") -> DataFrame:
    """Add ``burst``: spans of a key's events separated by a whole empty window.

    After such a gap nothing is remembered, so bursts are independent and even one key's
    traffic is spread. Gaps are looked for among (key, bin) pairs, not among events.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    step = int(window * 1_000_000)
    binned = events.withColumn("_bin", F.floor(micros / F.lit(step)))
    bins = binned.select(key, "_bin").distinct()
    order = Window.partitionBy(key).orderBy("_bin")
    starts = F.when(F.col("_bin") - F.lag("_bin", 1).over(order) <= 1, 0).otherwise(1)
    marked = bins.withColumn("_new", starts).withColumn(
        "burst", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return binned.join(marked, [key, "_bin"]).drop("_bin")


def admit_batch(events: DataFrame, limit: int, window: float) -> DataFrame:
    """Admission of events (client, event_id, ts): one row each with its verdict.

    Events are streamed through in time order per burst; a task holds at most ``limit``
    times however long a burst is, and never a whole client. Within one unbroken burst each
    verdict depends on the one before, so a burst is the unit that cannot be divided.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, hits = None, deque()
        for batch in batches:
            verdicts = []
            for client, burst, micros in zip(batch["client"], batch["burst"], batch["_us"]):
                if (client, burst) != current:
                    current, hits = (client, burst), deque()
                verdicts.append(admit_one(hits, micros / 1e6, limit, window))
            out = batch[["client", "event_id", "ts"]].copy()
            out["admitted"] = [v[0] for v in verdicts]
            out["retry_after"] = [v[1] for v in verdicts]
            yield out

    keyed = with_bursts(events.select("client", "event_id", F.col("ts").cast("timestamp").alias("ts")),
                        window).withColumn("_us", F.unix_micros("ts"))
    ordered = keyed.repartition("client", "burst").sortWithinPartitions(
        "client", "burst", "_us", "event_id")
    return ordered.mapInPandas(run, OUT)


def admit_stream(events: DataFrame, limit: int, window: float,
                 watermark: str | None = None) -> DataFrame:
    """The same verdicts over a stream; state is the admitted times, dropped once aged out.

    Hits may come as late as the window is long, or as late as ``watermark`` says.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
            ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = deque(state.get[0]) if state.exists else deque()
        # One trigger's rows of one client may arrive in any order.
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        seconds = rows["ts"].astype("datetime64[us]").astype("int64") / 1e6
        verdicts = [admit_one(hits, s, limit, window) for s in seconds]
        state.update((list(hits),))
        latest = int(seconds.iloc[-1] * 1000 + window * 1000) + 1
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))
        out = rows[["event_id", "ts"]].copy()
        out.insert(0, "client", key[0])
        out["admitted"] = [v[0] for v in verdicts]
        out["retry_after"] = [v[1] for v in verdicts]
        yield out

    source = events.select("client", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return source.withWatermark("ts", watermark or f"{int(window)} seconds").groupBy("client").applyInPandasWithState(
        run, OUT, "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)
