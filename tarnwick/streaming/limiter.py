"""A sliding rate limit: at most so many hits a key in any window; hits that are turned away don't count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def allow(times: list[float], limit: int, seconds: float, held: deque | None = None) -> list[bool]:
    """Verdicts for the times of one key, in order; held keeps the hits that count between calls."""
    held = deque() if held is None else held
    out = []
    for t in times:
        while held and held[0] <= t - seconds:
            held.popleft()
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out


def limited(hits: DataFrame, limit: int, seconds: float, key: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """Batch: hits with allowed.  A verdict depends on earlier verdicts, which no window function can say, so each key is folded in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, event], kind="stable")
        return pdf.assign(allowed=allow((pdf[ts].astype("int64") / (1e9 if "ns" in str(pdf[ts].dtype) else 1e6)).tolist(), limit, seconds))

    from pyspark.sql.types import BooleanType, StructField, StructType

    return hits.groupBy(key).applyInPandas(run, StructType([*hits.schema.fields, StructField("allowed", BooleanType())]))


def limited_stream(hits: DataFrame, limit: int, seconds: float, key: str = "user_id", delay: str = "10 minutes") -> DataFrame:
    """Streaming: (key, ts, allowed).

    The state of a key is the hits that count.  It goes once the watermark, delay behind the newest hit, has
    passed the window of the last of them, so keys that fall silent hold nothing; hits later than that are
    judged as the first of their key.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values("ts")
        times = (rows["ts"].astype("int64") / (1e9 if "ns" in str(rows["ts"].dtype) else 1e6)).tolist()
        out = pd.DataFrame({key: k[0], "ts": rows["ts"].to_numpy(), "allowed": allow(times, limit, seconds, held)})
        state.update((list(held),))
        state.setTimeoutTimestamp(max(int((held[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield out

    schema = {f.name: f for f in hits.schema}
    return hits.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(run, f"{key} {schema[key].dataType.simpleString()}, ts timestamp, allowed boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)
