"""A rate limiter over a stream: at most ``limit`` accepted events a key in the trailing window; rejected ones use no quota."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config

OUT = "key long, ts timestamp, accepted boolean"


def limit_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = config.RATE_LIMIT, seconds: int = config.RATE_WINDOW_S) -> DataFrame:
    """``key, ts, accepted`` for each event; the state of a key is the times of its accepted events in the window (``limit`` at most)."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        for p in parts:
            p = p.sort_values("ts")
            out = []
            for t in p["ts"].astype("int64") // 1000 if p["ts"].dtype == "datetime64[ns]" else p["ts"].astype("datetime64[us]").astype("int64"):
                times = [x for x in times if t - x < seconds * 1_000_000]
                out.append(len(times) < limit)
                if out[-1]:
                    times.append(int(t))
            yield pd.DataFrame({"key": k[0], "ts": p["ts"], "accepted": out})
        state.update((times,))

    keyed = events.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    return keyed.groupBy("key").applyInPandasWithState(step, OUT, "times array<long>", "append", GroupStateTimeout.NoTimeout)
