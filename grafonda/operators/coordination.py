"""Tasks, messages, ledgers and rate limits shared by agents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import micros
from .work import cut


def pending_tasks(tasks: DataFrame) -> DataFrame:
    """Open tasks with the dependencies that block them; an unknown dependency blocks."""
    done = tasks.where("status = 'done'").select(F.col("id").alias("dep"), F.lit(1).alias("done"))
    needs = tasks.where("status = 'pending'").select("id", F.explode("depends_on").alias("dep")).join(done, "dep", "left").where("done is null")
    blocked = needs.groupBy("id").agg(F.array_sort(F.collect_set("dep")).alias("blocked_by"))
    return tasks.where("status = 'pending'").join(blocked, "id", "left").select("id", "priority", F.coalesce("blocked_by", F.array().cast("array<string>")).alias("blocked_by"))


def unblocked_by(tasks: DataFrame, finished: str) -> DataFrame:
    """Pending tasks that wait for `finished` and whose other known dependencies are done; unknown ones are ignored."""
    status = tasks.select(F.col("id").alias("dep"), (F.col("status") == "done").alias("done"))
    waits = tasks.where((F.col("status") == "pending") & F.array_contains("depends_on", finished)).select("id", F.explode("depends_on").alias("dep")).join(status, "dep", "left")
    return waits.groupBy("id").agg(F.every(F.coalesce("done", F.lit(True)) | (F.col("dep") == finished)).alias("free")).where("free").select("id")


def plan_progress(plans: DataFrame, tasks: DataFrame) -> DataFrame:
    counted = tasks.groupBy("plan_id").agg(F.count("*").alias("total"), F.sum((F.col("status") == "done").cast("long")).alias("done"))
    return plans.join(counted, F.col("id") == F.col("plan_id"), "left").select("id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("done", F.lit(0)).alias("done"), (F.coalesce("total", F.lit(0)) > 0).__and__(F.col("total") == F.col("done")).alias("complete"))


def inbox(messages: DataFrame, agent: str, since: int) -> DataFrame:
    """Unread messages to an agent or to all, after a sequence number."""
    return messages.where((F.col("seq") > since) & (F.col("to_agent").isNull() | ((F.col("to_agent") == agent) & F.col("read_at").isNull()))).orderBy("seq")


def orphaned_tasks(actions: DataFrame) -> DataFrame:
    """task_id, agent_id: a task's last action where it was never completed."""
    last = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("created_at"), F.desc("id")))
    finished = actions.where("action = 'completed'").select("task_id").distinct()
    return actions.withColumn("rank", last).where("rank = 1").join(finished, "task_id", "left_anti").select("task_id", "agent_id")


def token_bucket(requests: DataFrame, by: str, at: str, per_minute: int, burst: int, order: str = "id") -> DataFrame:
    """requests with allowed: each key has a bucket of `burst` tokens that fills all the time, at per_minute, and a request takes one if
    there is one. A key's requests are folded in order, a batch at a time; where a key was silent for long enough to fill its bucket it
    starts afresh, so its history is cut there and dealt over tasks."""
    width = max(1, -(-60 * burst // per_minute))  # seconds to fill an empty bucket
    chunk, island, t = "_chunk", "_island", "_t"
    keyed = requests.withColumns({t: micros(at), chunk: F.floor(micros(at) / (width * 1_000_000))})
    chunks = keyed.select(by, chunk).distinct()
    before = F.lag(chunk).over(Window.partitionBy(by).orderBy(chunk))
    fresh = chunks.withColumn("rest", (F.col(chunk) - before > 1).cast("int"))  # a whole chunk without a request
    marked = fresh.withColumn(island, F.sum(F.coalesce("rest", F.lit(1))).over(Window.partitionBy(by).orderBy(chunk))).drop("rest")
    dealt = keyed.join(marked, [by, chunk]).repartition(by, island).sortWithinPartitions(by, island, t, order)
    names = [f.name for f in requests.schema.fields]
    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType())])

    def fold(batches):
        key, left, last = None, 0.0, 0
        for batch in batches:
            out = []
            for k, i, now in zip(batch.column(by).to_pylist(), batch.column(island).to_pylist(), batch.column(t).to_pylist(), strict=True):
                if (k, i) != key:
                    key, left, last = (k, i), float(burst), now
                left = min(float(burst), left + (now - last) / 6e7 * per_minute)
                last = now
                out.append(left >= 1)
                left -= out[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.bool_())], [*names, "allowed"])

    return dealt.select(*names, t, island).mapInArrow(fold, schema)


def ledger(entries: DataFrame, since: Column, keep: int = 10, cap: int = 20) -> DataFrame:
    """Recent work by session: its calls and up to `cap` entities."""
    recent = entries.where(F.col("created_at") >= since)
    entity = recent.select("session_id", F.explode_outer("entity_ids").alias("e")).groupBy("session_id").agg(F.slice(F.array_sort(F.collect_set("e")), 1, cap).alias("entities"))
    return recent.groupBy("session_id").agg(F.count("*").alias("calls"), F.max("created_at").alias("last")).join(entity, "session_id").orderBy(F.desc("last"), "session_id").limit(keep)


def timeline(**sources: DataFrame) -> DataFrame:
    """at, kind, id, text: several histories as one; sources are (id, at, text) by kind."""
    parts = [df.select("at", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "text") for kind, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Windows of sessions in seconds: a client that comes back within the first goes on with its session; one that comes back
# within the second wakes it up; others start anew.
RECONNECT, HIBERNATE = 300, 86_400


def session_chain(calls: DataFrame, by: list[str], at: str = "at", reconnect: int = RECONNECT, hibernate: int = HIBERNATE) -> DataFrame:
    """A row for each session of calls: its key, number, start, end, calls, how it came about (new, resumed or superseded) and its parent.
    Calls closer than `reconnect` belong to one session; a gap up to `hibernate` resumes the one before, a longer one supersedes it."""
    w = Window.partitionBy(*by).orderBy(at)
    seconds = F.floor(micros(at) / 1_000_000)
    gap = seconds - F.lag(seconds).over(w)
    marked = calls.withColumn("gap", gap).withColumn("number", F.sum(F.when(F.col("gap") > reconnect, 1).otherwise(0)).over(w))
    each = marked.groupBy(*by, "number").agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count("*").alias("calls"), F.max_by("gap", F.struct(-micros(at), F.coalesce("gap", F.lit(0)))).alias("gap"))
    how = F.when(F.col("number") == 0, "new").when(F.col("gap") <= hibernate, "resumed").otherwise("superseded")
    return each.select(*by, "number", "started_at", "ended_at", "calls", how.alias("state"), F.when(F.col("number") > 0, F.col("number") - 1).alias("parent"))


def stale_sessions(sessions: DataFrame, now: Column, idle_minutes: int, keep: int = 5) -> DataFrame:
    """Open sessions that have been idle for longer, the longest first."""
    idle = ((micros(now) - micros("last_seen_at")) / 6e7).cast("long")
    return sessions.where("ended_at is null").withColumn("idle_minutes", idle).where(F.col("idle_minutes") > idle_minutes).orderBy(F.desc("idle_minutes"), "session_id").limit(keep)


def tasks_by_node(tasks: DataFrame, node: str) -> DataFrame:
    """Tasks whose linked nodes hold node."""
    return tasks.where(F.array_contains("linked_nodes", node))


def latest_state(states: DataFrame, by: list[str], at: str = "at") -> DataFrame:
    """The latest row for each key."""
    rest = [c for c in states.columns if c not in by]
    return states.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("s")).select(*by, "s.*")


def events_since(events: DataFrame, seq: int, kinds: list[str] | None = None, agent: str | None = None, keep: int = 100) -> DataFrame:
    """Events after a sequence number, in order, of some kinds or one agent."""
    out = events.where(F.col("seq") > seq)
    out = out.where(F.col("type").isin(*kinds)) if kinds else out
    out = out.where(F.col("agent_id") == agent) if agent else out
    return out.orderBy("seq").limit(keep)


def overlaps(work: DataFrame, links: DataFrame | None = None, cap: int = 3) -> DataFrame:
    """a, b, level, shared: pairs of sessions of work(session_id, files, entities) that touch one file, or else one entity, or else (with
    links(entity, neighbour)) neighbours; up to cap of what they share. Pairs meet through what they share, not all with all."""
    every = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(c))))).alias(c)
    held = cut(work.groupBy("session_id").agg(every("files"), every("entities")), "work")
    first = lambda found: F.array_join(F.slice(found, 1, cap), ",")
    files, entities = F.array_intersect("p_files", "q_files"), F.array_intersect("p_entities", "q_entities")
    by_file = _meeting(held, "files", alike=("files",), good=files[0] == F.col("x"), shared=first(files)).select("a", "b", F.lit(0).alias("level"), "shared")
    apart = ~F.arrays_overlap("p_files", "q_files") & (entities[0] == F.col("x"))
    by_entity = _meeting(held, "entities", good=apart, shared=first(entities)).select("a", "b", F.lit(1).alias("level"), "shared")
    pairs = by_file.unionByName(by_entity)
    if links is None:
        return pairs
    own = work.select("session_id", F.explode(F.array_distinct("entities")).alias("x"))
    near = own.join(links.select(F.col("entity").alias("x"), "neighbour"), "x").select("session_id", F.col("neighbour").alias("x"), F.lit(2).alias("level")).distinct()
    further = _sharing(near, own.withColumn("level", F.lit(2))).groupBy("a", "b", "level").agg(F.slice(F.array_sort(F.collect_set("x")), 1, cap).alias("shared"))
    return pairs.unionByName(further.join(pairs, ["a", "b"], "left_anti").select("a", "b", "level", F.array_join("shared", ",").alias("shared")))


#: Sessions that a class's row names at most.
NAMED = 256


def _classes(held: DataFrame, alike: tuple[str, ...]) -> DataFrame:
    """piece, ids, and columns alike: sessions that hold the same, up to about NAMED in a row."""
    sizes = held.groupBy(*alike).agg(F.ceil(F.count("*") / NAMED).alias("k"))
    dealt = held.select("session_id", *alike).join(sizes, [*alike]).withColumn("k", F.pmod(F.xxhash64("session_id"), "k"))
    return cut(dealt.groupBy(*alike, "k").agg(F.collect_list("session_id").alias("ids")).select(F.monotonically_increasing_id().alias("piece"), "ids", *alike), "classes")


def _meeting(held: DataFrame, column: str, block: int = 2048, alike: tuple[str, ...] = ("files", "entities"), good: Column | None = None, **made: Column) -> DataFrame:
    """x, a, b: unordered pairs of sessions, once for each x that `column` of both holds. good and made are a condition and further columns, by x and
    columns alike of both sides (p_, q_): they are found once for all sessions that hold the same.

    Sessions of one x lie in blocks of about `block`, and a task has a pair of blocks at a time: a common x is many tasks, and pairs go from
    there to the result without a shuffle."""
    each = _classes(held, alike).withColumn("x", F.explode(column))
    sizes = cut(each.groupBy("x").agg(F.ceil(F.sum(F.size("ids")) / block).alias("k")), "touched")
    cells = sizes.agg(F.sum(F.expr("k * (k + 1) / 2"))).first()[0] or 1
    parts = max(held.sparkSession.sparkContext.defaultParallelism, min(int(cells), 4096))
    dealt = each.join(sizes, "x").withColumn("own", F.expr("pmod(xxhash64(piece), k)"))
    side = lambda n: [F.col(c).alias(f"{n}_{c}") for c in ("piece", "ids", *alike)]
    one = dealt.select("x", F.col("own").alias("i"), F.explode(F.expr("sequence(own, k - 1)")).alias("j"), *side("p")).repartition(parts, "x", "i", "j")
    other = dealt.select("x", F.explode(F.expr("sequence(0, own)")).alias("i"), F.col("own").alias("j"), *side("q")).repartition(parts, "x", "i", "j")
    both = one.join(other.hint("merge"), ["x", "i", "j"]).where("i < j or p_piece <= q_piece")
    both = both.where(good) if good is not None else both
    both = both.select("x", "p_ids", "q_ids", (F.col("p_piece") == F.col("q_piece")).alias("same"), *[v.alias(n) for n, v in made.items()])
    pairs = both.withColumn("p", F.explode("p_ids")).withColumn("q", F.explode("q_ids")).where("not same or p < q")
    return pairs.select("x", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), *made)


def _sharing(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = left.select(F.col("session_id").alias("a"), "x", "level"), right.select(F.col("session_id").alias("b"), "x", "level")
    both = a.join(b, ["x", "level"]).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "level", "x").distinct()


def unseen_alerts(alerts: DataFrame, seen: DataFrame) -> DataFrame:
    """alerts(a, b, level, shared) with a hash, without those whose hash was seen."""
    keyed = alerts.withColumn("hash", F.sha1(F.concat_ws("|", "a", "b", "level", "shared")))
    return keyed.join(seen.select("hash"), "hash", "left_anti")


def with_outcomes(deliveries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """deliveries with the outcome of their session where they have none yet."""
    last = outcomes.groupBy("session_id").agg(F.max("outcome").alias("found"))
    return deliveries.join(last, "session_id", "left").withColumn("outcome", F.coalesce(F.nullif(F.col("outcome"), F.lit("")), "found")).drop("found")


def new_annotations(existing: DataFrame, new: DataFrame, minutes: int) -> DataFrame:
    """new(node_id, agent_id, note, at) without those whose same note by the same agent on the same node is at most so many minutes old, in
    existing or earlier in new."""
    key = ["node_id", "agent_id", "note"]
    every = existing.select(*key, "at", F.lit(False).alias("new")).unionByName(new.select(*key, "at", F.lit(True).alias("new")))
    gap = micros("at") - F.lag(micros("at")).over(Window.partitionBy(*key).orderBy("at", "new"))
    return every.withColumn("gap", gap).where(F.col("new") & (F.col("gap").isNull() | (F.col("gap") > minutes * 60_000_000))).select(*key, "at")


def agents_present(agents: DataFrame, now: Column) -> DataFrame:
    """presence -> number of agents, by when they were last seen."""
    from ..functions.scalars import presence

    minutes = (micros(now) - micros("last_seen_at")) / 6e7
    return agents.groupBy(presence(minutes).alias("presence")).agg(F.count("*").alias("agents"))


def package_work(events: DataFrame, cap: int = 20) -> DataFrame:
    """dir, files, entities: what a session touched by folder; at most cap folders, the busiest first."""
    folder = F.when(F.contains("file", F.lit("/")), F.regexp_replace("file", "/[^/]*$", "")).otherwise(".")
    return events.groupBy(folder.alias("dir")).agg(F.countDistinct("file").alias("files"), F.countDistinct("entity").alias("entities")).orderBy(F.desc("files"), F.desc("entities"), "dir").limit(cap)


def session_trend(sessions: DataFrame) -> DataFrame:
    """One row: first, second, trend: hit rates of the earlier and the later half of sessions (started_at, hits, total), each weighed by its
    size; a change of over .05 is a trend."""
    counted = sessions.select("started_at", "session_id", "hits", "total")
    half = F.ntile(2).over(Window.orderBy("started_at", "session_id"))  # one agent's sessions
    rate = lambda k: F.coalesce(F.sum(F.when(F.col("half") == k, F.col("hits"))) / F.nullif(F.sum(F.when(F.col("half") == k, F.col("total"))), F.lit(0)), F.lit(0.0))
    out = counted.withColumn("half", half).agg(rate(1).alias("first"), rate(2).alias("second"))
    return out.withColumn("trend", F.when(F.col("second") - F.col("first") > 0.05, "improving").when(F.col("first") - F.col("second") > 0.05, "declining").otherwise("stable"))


def call_summary(calls: DataFrame, by: str, keep: int = 10) -> DataFrame:
    """by, calls, error_rate, busy_ms, tools: with its most used tools as name:calls, joined by commas."""
    tools = calls.groupBy(by, "tool_name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "tool_name"))
    named = tools.withColumn("rank", rank).where(F.col("rank") <= keep).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tool_name", "n"))), lambda x: F.concat_ws(":", x["tool_name"], x["n"].cast("string"))), ",").alias("tools"))
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.round(1 - F.avg("success"), 6).alias("error_rate"), F.sum("duration_ms").alias("busy_ms")).join(named, by)
