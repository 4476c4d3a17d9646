"""Keyed state machines: sliding-window admission, write-log replay, throttled progress. Pure functions first, then Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The sliding window, its limit, the pause after a failed replay, the least growth of a saved progress.
WINDOW_MS, LIMIT, BACKOFF_MS, GROWTH = 60_000, 30, 60_000, 0.005
TRANSIENT = {401, 408, 425, 429}


def admit(times: list[int], recent: list[int], window: int = WINDOW_MS, limit: int = LIMIT) -> tuple[list[bool], list[int]]:
    """Which requests (in time order) pass: only admitted ones of the last window count. Returns decisions and the new state."""
    out = []
    for t in times:
        recent = [r for r in recent if t - r < window]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out, recent


def outcome(status: int | None) -> str:
    if status is None or status >= 500:
        return "retry"
    if 400 <= status < 500:
        return "retry" if status in TRANSIENT else "drop"
    return "done" if status < 300 else "retry"


def replay(log: list[dict], now: int, backoff: int = BACKOFF_MS) -> list[dict]:
    """One flush of a write log (oldest first; op has status, attempts, last_attempt_at): each op with its new state.

    Successes leave, permanent errors drop out without blocking, the first transient error stops the flush and is marked;
    an op that failed within the pause stops it before it starts.
    """
    out, stopped = [], False
    for op in log:
        state = dict(op, state="pending")
        if not stopped:
            if op["attempts"] > 0 and now - (op["last_attempt_at"] or 0) < backoff:
                stopped = True
            else:
                state["state"] = {"done": "flushed", "drop": "dropped"}.get(outcome(op["status"]), "pending")
                if state["state"] == "pending":
                    state |= {"attempts": op["attempts"] + 1, "last_attempt_at": now}
                    stopped = True
        out.append(state)
    return out


def saved(progress: list[float], last: float = 0.0, growth: float = GROWTH) -> tuple[list[bool], float]:
    """Which progress values are worth saving: the maximum must have grown by more than growth."""
    out = []
    for p in progress:
        out.append(p > last + growth)
        last = p if out[-1] else last
    return out, last


def admitted(requests: DataFrame, window: int = WINDOW_MS, limit: int = LIMIT) -> DataFrame:
    """requests: user_id, at (ms), id. Adds admitted, by streaming each user's requests in time order through admit.

    Rows are partitioned by user and sorted; a user is never held in memory, only the last window of admitted times is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, recent = object(), []
        for pdf in batches:
            flags: list[bool] = []
            for name, part in pdf.groupby("user_id", sort=False, dropna=False):
                if name != user:
                    user, recent = name, []
                got, recent = admit(part["at"].tolist(), recent, window, limit)
                flags += got
            yield pdf.assign(admitted=flags)

    rows = requests.select("user_id", "at", "id").where("user_id IS NOT NULL").repartition("user_id").sortWithinPartitions("user_id", "at", "id")
    return rows.mapInPandas(run, "user_id long, at long, id long, admitted boolean")


def flushed(log: DataFrame, now: Column, backoff: int = BACKOFF_MS) -> DataFrame:
    """One flush of every user's write log: replay() as windows. log: id, user_id, at, status, attempts; adds state, attempts counts on.

    An operation stops its user's flush if it still pauses after a failure, or if it fails for the time being.
    """
    result = F.when(F.col("status") < 300, "flushed").when(F.col("status").between(400, 499) & ~F.col("status").isin(*TRANSIENT), "dropped").otherwise("pending")
    x = log.withColumns({"outcome": result, "waits": (F.col("attempts") > 0) & (now - F.col("at") < backoff), "place": F.struct("at", "id")})
    stops = x.where("waits OR outcome = 'pending'").groupBy("user_id").agg(F.min("place").alias("stop"))
    y = x.join(stops, "user_id", "left")
    before = F.col("stop").isNull() | (F.col("place") < F.col("stop"))
    tried = F.coalesce(F.col("place") == F.col("stop"), F.lit(False)) & ~F.col("waits")
    return y.select("id", "user_id", F.when(before, F.col("outcome")).otherwise("pending").alias("state"), (F.col("attempts") + tried.cast("int")).alias("attempts"))


def throttled(progress: DataFrame, growth: float = GROWTH) -> DataFrame:
    """progress: user_id, at, id, progress. Adds saved, by streaming each user's values in time order through saved()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, last = object(), 0.0
        for pdf in batches:
            flags: list[bool] = []
            for name, part in pdf.groupby("user_id", sort=False, dropna=False):
                if name != user:
                    user, last = name, 0.0
                got, last = saved(part["progress"].tolist(), last, growth)
                flags += got
            yield pdf[["user_id", "at", "id"]].assign(saved=flags)

    rows = progress.select("user_id", "at", "id", "progress").where("user_id IS NOT NULL").repartition("user_id").sortWithinPartitions("user_id", "at", "id")
    return rows.mapInPandas(run, "user_id long, at long, id long, saved boolean")


def admitted_stream(requests: DataFrame, window: int = WINDOW_MS, limit: int = LIMIT) -> DataFrame:
    """The same over a stream, the admitted times of the last window kept as state of each user."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        got, recent = admit(rows["at"].tolist(), list(state.get[0]) if state.exists else [], window, limit)
        state.update((recent,))
        yield pd.DataFrame({"user_id": key[0], "at": rows["at"], "id": rows["id"], "admitted": got})

    return requests.select("user_id", "at", "id").groupBy("user_id").applyInPandasWithState(
        run, "user_id long, at long, id long, admitted boolean", "recent array<long>", "append", GroupStateTimeout.NoTimeout
    )


def daily_totals(stream: DataFrame, key: str, at_ms: str, value: str, late: str = "1 day") -> DataFrame:
    """Tumbling UTC days over a ledger stream; rows exactly at midnight open no day. The watermark bounds the state."""
    ts = F.timestamp_millis(F.col(at_ms))
    rows = stream.where(F.pmod(at_ms, F.lit(86_400_000)) != 0).withColumn("ts", ts).withWatermark("ts", late)
    sums = rows.groupBy(key, F.window("ts", "1 day").alias("w")).agg(F.sum(F.col(value).cast("decimal(18,9)")).cast("double").alias("total"), F.count("*").alias("n"))
    return sums.select(key, F.unix_date(F.to_date("w.start")).cast("long").alias("day"), "total", "n")
