"""What a session's tools answer, as joins over the stores: how a session starts and ends, what is being worked on, an agent's figures, and an
orientation in the code. Each gives rows for all sessions, agents or files at once; texts are left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .telemetry import count_if, ratio

# How many key types and packages an orientation names, changed files a working state looks into, and callers that make an
# entity worth naming there.
KEY_TYPES, PACKAGES, CHANGED_FILES, MANY_CALLERS = 10, 12, 5, 3


def explained(nodes: DataFrame, edges: DataFrame, is_test: Column, refs_without: tuple[str, ...] = ("DEFINES", "IMPORTS")) -> DataFrame:
    """section, place, name, value: an orientation: scale (counts of files, functions, structs and edges), types (the most referred to structs
    and interfaces outside tests) and packages (by references to their entities), each with its number of references."""
    kinds = {"files": ("file",), "functions": ("function", "method"), "structs": ("struct",)}
    counts = nodes.agg(*[count_if(F.col("type").isin(*v)).alias(k) for k, v in kinds.items()]).select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(k).alias("name"), F.col(k).alias("value")) for i, k in enumerate(kinds)])))
    scale = counts.unionByName(edges.agg(F.count("*").alias("value")).select(F.lit(4).alias("place"), F.lit("edges").alias("name"), "value"))
    refs = edges.where(~F.col("type").isin(*refs_without)).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("value"))
    known = nodes.select("id", "type", "name", "package", is_test.alias("test")).join(refs, "id")
    first = lambda df, order, n: df.orderBy(F.desc("value"), *order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), *order)))  # noqa: E731  n rows
    types = first(known.where("type in ('struct', 'interface') and not test").select("id", "name", "value"), ["id"], KEY_TYPES)
    packages = first(known.groupBy(F.col("package").alias("name")).agg(F.sum("value").alias("value")), ["name"], PACKAGES)
    parts = [df.select(F.lit(s).alias("section"), F.col("place").cast("int").alias("place"), "name", F.col("value").cast("long").alias("value")) for s, df in (("scale", scale), ("types", types), ("packages", packages))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def session_start(agents: DataFrame, sessions: DataFrame, tasks: DataFrame, messages: DataFrame, failures: DataFrame, now: Column, resume_hours: int = 24) -> DataFrame:
    """agent_id, pending_tasks, unread, session_resumed, other_agents, last_failure: what each of agents(agent_id) is told when it starts: its tasks
    (agent_id, status) that are not done, messages (to_agent, null: all; read_at) not read, the latest session (session_id, agent_id,
    started_at, ended_at) of its own that is open and young enough to go on with, how many other agents have an open one, and its
    latest failure (agent_id, created_at, entity)."""
    open_ = sessions.where(F.col("ended_at").isNull() & (F.col("started_at") <= now))
    young = open_.where(F.col("started_at") > now - F.make_interval(hours=F.lit(resume_hours)))
    resumed = young.groupBy("agent_id").agg(F.max_by("session_id", F.struct("started_at", "session_id")).alias("session_resumed"))
    pending = tasks.where("status <> 'done'").groupBy("agent_id").agg(F.count("*").alias("pending_tasks"))
    unread = messages.where("read_at is null")
    own = unread.where("to_agent is not null").groupBy(F.col("to_agent").alias("agent_id")).agg(F.count("*").alias("own"))
    to_all = unread.where("to_agent is null").agg(F.count("*").alias("to_all"))  # one row
    busy = open_.select("agent_id").distinct()
    failed = failures.where(F.col("created_at") <= now).groupBy("agent_id").agg(F.max_by("entity", F.struct("created_at", "entity")).alias("last_failure"))
    out = agents.select("agent_id").distinct()
    for part in (pending, own, resumed, failed, busy.withColumn("busy", F.lit(1))):
        out = out.join(part, "agent_id", "left")
    out = out.join(F.broadcast(to_all)).join(F.broadcast(busy.agg(F.count("*").alias("all_busy")))).fillna(0, ["pending_tasks", "own", "busy"])
    return out.select("agent_id", "pending_tasks", (F.col("own") + F.col("to_all")).alias("unread"), "session_resumed", (F.col("all_busy") - F.col("busy")).alias("other_agents"), "last_failure")


def working_state(changes: DataFrame, nodes: DataFrame, edges: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """file, changed, last, id, callers: the files of changes(file, at) of the last minutes, the CHANGED_FILES latest of them with their entities
    that over MANY_CALLERS others call (else id is null, callers 0)."""
    recent = changes.where((F.col("at") > now - F.make_interval(mins=F.lit(minutes))) & (F.col("at") <= now)).groupBy("file").agg(F.count("*").alias("changed"), F.max("at").alias("last"))
    latest = recent.orderBy(F.desc("last"), "file").limit(CHANGED_FILES)
    there = nodes.join(F.broadcast(latest.select("file")), "file", "left_semi").select("id", "file")
    callers = edges.where("type = 'CALLS'").join(there.select(F.col("id").alias("to_id")), "to_id", "left_semi").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("callers")).where(F.col("callers") > MANY_CALLERS)
    return recent.join(there.join(callers, "id"), "file", "left").select("file", "changed", "last", "id", F.coalesce("callers", F.lit(0)).alias("callers"))


def my_analytics(tc: DataFrame, cd: DataFrame, s: DataFrame, os: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """agent_id, tool_calls, deliveries, tokens_saved, sessions, tasks_completed, cache_hit_rate, avg_latency_ms, savings_pct, weakest: each agent's
    figures of the last days, and the entity of its corrections that needed most."""
    young = lambda df, at: df.where((F.col(at).cast("date") > F.date_sub(today, days)) & (F.col(at).cast("date") <= today))
    calls = young(tc, "created_at").groupBy("agent_id").agg(F.count("*").alias("tool_calls"), F.round(F.avg("duration_ms"), 4).alias("avg_latency_ms"))
    given = young(cd, "created_at").groupBy("agent_id").agg(F.count("*").alias("deliveries"), F.sum("baseline_tokens").alias("baseline"), F.sum("response_tokens").alias("delivered"), F.sum("cache_hit").alias("hits"))
    held = young(s, "started_at").groupBy("agent_id").agg(F.count("*").alias("sessions"), F.sum("tasks_completed").alias("tasks_completed"))
    wrong = young(os.where("signal_type = 'correction'"), "created_at").groupBy("agent_id", "entity").agg(F.count("*").alias("n"))
    weakest = wrong.groupBy("agent_id").agg(F.min_by("entity", F.struct(-F.col("n"), "entity")).alias("weakest"))
    saved = F.greatest(F.lit(0), F.col("baseline") - F.col("delivered"))
    out = calls.join(given, "agent_id", "left").join(held, "agent_id", "left").join(weakest, "agent_id", "left").fillna(0, ["deliveries", "baseline", "delivered", "hits", "sessions", "tasks_completed"])
    return out.select("agent_id", "tool_calls", "deliveries", saved.alias("tokens_saved"), "sessions", "tasks_completed", ratio(F.col("hits"), F.col("deliveries")).alias("cache_hit_rate"), "avg_latency_ms", ratio(100 * saved, F.col("baseline")).alias("savings_pct"), "weakest")


def session_end(tc: DataFrame, s: DataFrame, os: DataFrame, keep: int = 5) -> DataFrame:
    """session_id, minutes, calls, failed, tools, entities, tasks_done, corrections, next_step: the record that each ended session leaves: what was
    called, the entities it was most about (the first `keep`), what was done, and what the next one should look at: the entity of its last
    correction, if nothing was done about it since."""
    ended = s.where("ended_at is not null").select("session_id", F.round((F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 60_000_000, 4).alias("minutes"))
    called = tc.groupBy("session_id").agg(F.count("*").alias("calls"), count_if(F.col("success") == 0).alias("failed"), F.array_join(F.array_sort(F.collect_set("tool_name")), ",").alias("tools"))
    about = tc.where("entity is not null").groupBy("session_id", "entity").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "entity"))
    top = about.withColumn("rank", rank).where(F.col("rank") <= keep).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda x: x["entity"]), ",").alias("entities"))
    signals = os.groupBy("session_id").agg(
        count_if(F.col("signal_type") == "task_done").alias("tasks_done"), count_if(F.col("signal_type") == "correction").alias("corrections"),
        F.max_by(F.struct("signal_type", "entity"), F.struct("created_at", "id")).alias("last"),
    )
    out = ended.join(called, "session_id").join(top, "session_id", "left").join(signals, "session_id", "left").fillna(0, ["tasks_done", "corrections"])
    return out.select("session_id", "minutes", "calls", "failed", "tools", F.coalesce("entities", F.lit("")).alias("entities"), "tasks_done", "corrections", F.when(F.col("last.signal_type") == "correction", F.col("last.entity")).alias("next_step"))
