"""A bounded collector of events as a stateful stream: a ring of each source's latest events, flushed by a timer of event time and early
when it is nearly full, with counters of what was dropped, how full it was and what came late.

Within an interval, the first time that a ring is EARLY full it is flushed at once; until the interval's end the sink counts as busy, so
further events fill the ring and push its oldest ones out. The end of an interval flushes what is held: when the source's next event
belongs to a later one, or when the watermark passes it. A late event, of an interval that is over, is kept and counted as late; one behind
the watermark's bound of `late` is Spark's to drop.

State is bounded: one ring of at most `capacity` ids for each source and shard. A source with most of all events is dealt to `shards` rings
by a hash of the id, each of its own counters; sums over shards are the source's.

Nulls: a null source is a source; rows without a time or an id are left out. Events of a micro-batch are taken in order of time and id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import scans

#: The share of the capacity at which a ring is flushed before its time.
EARLY = 0.8
_STATE = "interval long, early boolean, ring array<long>, enqueued long, dropped long, high_water long, late long"
_OUT = "source string, shard int, interval long, kind string, n int, ids array<long>, enqueued long, dropped long, high_water long, late long"


class Ring:
    """The ring of one source and shard. Flushes are (interval, kind, ids) with the counters at that time."""

    def __init__(self, capacity: int, held: tuple | None = None):
        self.capacity = capacity
        self.interval, self.early, ring, *counters = held or (-1, False, [], 0, 0, 0, 0)
        self.ring, self.enqueued, self.dropped, self.high_water, self.late = list(ring), *map(int, counters)

    def state(self) -> tuple:
        return self.interval, self.early, self.ring, self.enqueued, self.dropped, self.high_water, self.late

    def flush(self, kind: str) -> list[tuple]:
        out = [(self.interval, kind, len(self.ring), self.ring, self.enqueued, self.dropped, self.high_water, self.late)] if self.ring else []
        self.ring = []
        return out

    def push(self, interval: int, event: int) -> list[tuple]:
        out = []
        if interval > self.interval:
            out = self.flush("timer")
            self.interval, self.early = interval, False
        self.late += interval < self.interval
        self.enqueued += 1
        if len(self.ring) == self.capacity:
            del self.ring[0]
            self.dropped += 1
        self.ring.append(event)
        self.high_water = max(self.high_water, len(self.ring))
        if not self.early and len(self.ring) >= EARLY * self.capacity:
            self.early = True
            out += self.flush("early")
        return out


def collected(events: DataFrame, source: str, event: str, at: str, capacity: int = 1000, seconds: int = 5, shards: int = 1, late: str = "1 minute") -> DataFrame:
    """A row for each flush: source, shard, interval (its number since 1970), kind (early or timer), n, ids, and the counters so far: enqueued,
    dropped, high_water, late. events: a stream, or a table (then every ring ends flushed)."""
    width = seconds * 1000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = Ring(capacity, state.get if state.exists else None)
        if state.hasTimedOut:
            out = ring.flush("timer")
        else:
            out = []
            rows = pd.concat(list(batches)).sort_values(["ms", "event"])
            for ms, number in zip(rows["ms"].tolist(), rows["event"].tolist(), strict=True):
                out += ring.push(ms // width, number)
        state.update(ring.state())
        if ring.ring:
            state.setTimeoutTimestamp(max((ring.interval + 1) * width, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], key[1], *x) for x in out], columns=[c.split()[0] for c in _OUT.split(", ")])

    time = F.col(at).cast("timestamp")
    rows = events.where(F.col(at).isNotNull() & F.col(event).isNotNull())
    rows = rows.select(F.col(source).cast("string").alias("source"), _shard(F.col(event), shards).alias("shard"), F.col(event).cast("long").alias("event"), time.alias("at"), F.unix_millis(time).alias("ms"))
    if not events.isStreaming:

        def whole(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
            ring, out = Ring(capacity), []
            for number in table.sort_values(["ms", "event"])["event"].tolist():
                out += ring.push(key[2], number)
            return pd.DataFrame([(*key[:2], *x) for x in out + ring.flush("timer")], columns=[c.split()[0] for c in _OUT.split(", ")])

        # a table in order has no late rows, and a ring is empty at the end of an interval: intervals are independent but for running counters
        found = rows.withColumn("interval", F.floor(F.col("ms") / width)).groupBy("source", "shard", "interval").applyInPandas(whole, _OUT)
        ring = ["source", "shard"]
        placed = scans.with_previous(scans.chunks(found, ring, ["interval", "kind"], "flushes"), [*ring, "interval"], {"_e": "enqueued", "_d": "dropped"})
        for c, before in (("enqueued", "_e"), ("dropped", "_d")):  # an interval's second flush has counted its first
            placed = scans.with_sum(placed, ring, F.col(c) - F.coalesce(before, F.lit(0)), f"all_{c}")
        placed = scans.with_max(placed, ring, F.col("high_water"), "most")
        return placed.select("source", "shard", "interval", "kind", "n", "ids", F.col("all_enqueued").alias("enqueued"), F.col("all_dropped").alias("dropped"), F.col("most").alias("high_water"), "late")
    return rows.withWatermark("at", late).groupBy("source", "shard").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _shard(event: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), event), F.lit(shards)).cast("int")


def drop_rates(flushes: DataFrame) -> DataFrame:
    """source, enqueued, dropped, late, high_water (of its fullest ring), drop_rate: of all flushes so far."""
    last = flushes.groupBy("source", "shard").agg(*[F.max(c).alias(c) for c in ("enqueued", "dropped", "late", "high_water")])
    out = last.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("enqueued", "dropped", "late")], F.max("high_water").alias("high_water"))
    return out.withColumn("drop_rate", F.round(F.coalesce(F.try_divide(F.col("dropped").cast("double"), F.col("enqueued")), F.lit(0.0)), 6))
