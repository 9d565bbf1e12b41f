"""Streams of events: rolling counts, debouncing, deduplicated alerts, uptime and per-key rate limits, with watermarks.

Every function takes a streaming (or batch) DataFrame with a timestamp column and returns one; state is bounded by the
watermark or by a timer, and sinks are idempotent by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import coordination

LATE = "1 day"


def tumbling(events: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Counts per window and key. Rows later than `late` are left out; others change their window."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sliding(events: DataFrame, at: str, value: str, width: str = "1 hour", step: str = "15 minutes", late: str = LATE) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width, step)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, at: str, by: list[str], gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def debounced(changes: DataFrame, at: str, file: str, content: str, quiet: str = "150 milliseconds", late: str = "1 minute") -> DataFrame:
    """One row per burst of changes to a file: the last content, once the file was quiet."""
    return changes.withWatermark(at, late).groupBy(F.session_window(at, quiet), file).agg(F.max_by(content, at).alias(content), F.count("*").alias("changes"), F.max(at).alias(at)).drop("session_window")


def alerts_once(alerts: DataFrame, at: str, keys: list[str], within: str = "1 hour") -> DataFrame:
    """The first alert of each kind within a watermark's span."""
    return alerts.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def uptime(beats: DataFrame, at: str, minutes: int = 60, late: str = LATE) -> DataFrame:
    """Per day: hours with a heartbeat, as a share of 24."""
    hours = beats.withWatermark(at, late).groupBy(F.window(at, "1 day"), F.date_trunc("hour", at).alias("hour")).agg(F.count("*").alias("beats"))
    return hours.select(F.col("window.start").alias("day"), "hour", F.least(F.col("beats") * minutes, F.lit(60)).alias("minutes_up"))


def notified(changes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """A stream of changed nodes joined to who follows them (a table): messages."""
    return changes.join(F.broadcast(links) if _small(links) else links, key)


def _small(df: DataFrame, most: int = 8 << 20) -> bool:
    """Whether the optimiser's own estimate is within the bound."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()) <= most


def rate_limited(requests: DataFrame, key: str, at: str, per_minute: int, burst: int, late: str = "10 minutes") -> DataFrame:
    """requests with allowed: a token bucket per key. In a stream it lives in the state until the watermark says that it would be full; a
    batch of a key is judged in the order of time (a stream gives its batches in order). A table is folded by coordination.token_bucket."""
    if not requests.isStreaming:
        return coordination.token_bucket(requests, key, at, per_minute, burst, order=at)
    names = [f.name for f in requests.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields), "allowed boolean"])

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        left, last = state.get if state.exists else (float(burst), 0)
        every = list(batches)  # a micro-batch of one key: rows may be out of order over its chunks
        rows = pd.concat(every).sort_values(at, kind="stable") if every else None
        if rows is None:
            return
        allowed = []
        for t in rows[at].astype("datetime64[us]").astype("int64"):
            left = min(float(burst), left + (t - (last or t)) / 6e7 * per_minute) if t > (last or t) else left
            last = max(last, t)
            allowed.append(left >= 1)
            left -= 1.0 if left >= 1 else 0.0
        state.update((left, int(last)))
        state.setTimeoutTimestamp(max(int(last) // 1000 + 60_000 * max(1, -(-burst // per_minute)), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(allowed=allowed)[[*names, "allowed"]]

    return requests.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, schema, "left double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def batches_to(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Micro-batches to a function of (rows, batch number), which must be idempotent by number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolled_up(batch: DataFrame, store: DataFrame) -> DataFrame:
    """A roll-up table (day, metric, value) with a batch of the same: the batch's value of a day and metric replaces the stored one, so a
    batch that is replayed counts once."""
    return store.join(batch.select("day", "metric"), ["day", "metric"], "left_anti").select("day", "metric", "value").unionByName(batch.select("day", "metric", "value"))


def missing_days(batch: DataFrame, store: DataFrame) -> DataFrame:
    """The rows of batch for days that the store has no row of: late events of a day that is rolled up change nothing."""
    return batch.join(store.select("day").distinct(), "day", "left_anti")


def heartbeats(events: DataFrame, at: str, late: str = LATE) -> DataFrame:
    """hour, beats."""
    return tumbling(events, at, [], "1 hour", late)


def recent_changes(changes: DataFrame, at: str, file: str, now, minutes: int) -> DataFrame:
    """file, changes, last: what changed in the last minutes."""
    return changes.where(F.col(at) > now - F.expr(f"INTERVAL {minutes} MINUTES")).groupBy(file).agg(F.count("*").alias("changes"), F.max(at).alias("last"))


def import_graph(imports: DataFrame, changed: DataFrame | None = None, new: DataFrame | None = None) -> DataFrame:
    """package, file of imports(file, package); with changed(file) those files' rows are replaced by new's."""
    held = imports.select("package", "file").distinct()
    return held if changed is None else held.join(changed.select("file"), "file", "left_anti").select("package", "file").unionByName(new.select("package", "file").distinct())


def new_violations(found: DataFrame, logged: DataFrame) -> DataFrame:
    """Violations whose id is not logged yet."""
    return found.join(logged.select("id"), "id", "left_anti")


def reparsed(known: DataFrame, files: DataFrame) -> DataFrame:
    """files(path, content) whose content hash differs from known(path, hash), with the hash: those to be parsed again."""
    hashed = files.withColumn("hash", F.sha2(F.col("content"), 256))
    return hashed.join(known.select("path", F.col("hash").alias("old")), "path", "left").where(F.col("old").isNull() | (F.col("old") != F.col("hash"))).drop("old")
