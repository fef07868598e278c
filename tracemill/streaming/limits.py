"""Streams: append and counter sinks, resuming by checkpoint, rate limits with a cooldown, key pools and retries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A window of so many seconds with so many events starts a cooldown of so many seconds.
WINDOW, EVENTS, COOLDOWN = 10.0, 5, 30.0


def stream_of(table: DataFrame) -> DataFrame:
    """The files of a batch table as a stream."""
    folder, name = table.inputFiles()[0].rsplit("/", 1)
    reader = table.sparkSession.readStream.schema(table.schema)
    return (reader if folder.endswith(".parquet") else reader.option("pathGlobFilter", name)).parquet(folder)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is new since the checkpoint, appended to Parquet files exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def counters_to(stream: DataFrame, by: str, hit: str, path: str, checkpoint: str) -> None:
    """Running n and correct of every key; each batch writes the keys that changed, with its number."""
    counts = stream.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(hit)).alias("correct"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/b{number}")

    counts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def limited(times: list[float], recent: list[float], until: float, window: float = WINDOW, events: int = EVENTS, cooldown: float = COOLDOWN) -> tuple[list[bool], list[float], float]:
    """Whether each event, in order of time, meets a cooldown; and the state after them.

    Events outside a cooldown are counted inside the window before each; the ``events``-th starts a cooldown and empties the count.
    """
    out = []
    for at in times:
        out.append(at < until)
        if at < until:
            continue
        recent = [x for x in recent if x >= at - window] + [at]
        if len(recent) >= events:
            until, recent = at + cooldown, []
    return out, recent, until


def rate_limits(stream: DataFrame, key: str, at: str, event: str, window: float = WINDOW, events: int = EVENTS, cooldown: float = COOLDOWN) -> DataFrame:
    """(key, event, cooling) of a stream; the state of a key is its recent times (under ``events`` of them) and its cooldown's end.

    Events of one batch are taken in order of time, so a batch should hold whole spans of time.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, until = state.get if state.exists else ([], -math.inf)
        rows = pd.concat(list(parts)).sort_values(["at", "event"])
        cooling, recent, until = limited(rows["at"].tolist(), list(recent), until, window, events, cooldown)
        state.update((recent, until))
        yield pd.DataFrame({"key": [k[0]] * len(rows), "event": rows["event"].to_numpy(), "cooling": cooling})

    rows = stream.select(F.col(key).cast("long").alias("key"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("at"), F.col(event).cast("long").alias("event"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, event long, cooling boolean", "recent array<double>, until double", "append", GroupStateTimeout.NoTimeout)


class KeyPool:
    """Keys in turn; one that was limited rests for its cooldown."""

    def __init__(self, keys: list[str], clock: Callable[[], float], cooldown: float = COOLDOWN):
        self.keys, self.clock, self.cooldown = list(dict.fromkeys(keys)), clock, cooldown
        self.rest = dict.fromkeys(self.keys, -math.inf)
        self.at = 0

    def next(self) -> str | None:
        """The next key that does not rest; None if all do."""
        for step in range(len(self.keys)):
            key = self.keys[(self.at + step) % len(self.keys)]
            if self.rest[key] <= self.clock():
                self.at = (self.at + step + 1) % len(self.keys)
                return key
        return None

    def limited(self, key: str) -> None:
        self.rest[key] = self.clock() + self.cooldown


def waits(attempts: int, base: float = 1.0, cap: float = 60.0) -> list[float]:
    """Seconds before each retry: doubled every time, up to a cap."""
    return [min(cap, base * 2**k) for k in range(max(0, attempts - 1))]


def retried(call: Callable[[], object], attempts: int, kind: Callable[[Exception], str], sleep: Callable[[float], None], base: float = 1.0, cap: float = 60.0) -> object:
    """The call's result; limited and passing failures are tried again after a wait, others and the last one are raised."""
    for wait in [*waits(attempts, base, cap), None]:
        try:
            return call()
        except Exception as error:
            if wait is None or kind(error) not in ("rate_limit", "transient"):
                raise
            sleep(wait)
    return None
