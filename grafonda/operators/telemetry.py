"""Usage, quality and cost analytics over tool calls (tc), context deliveries (cd), sessions (s) and outcome signals (os).

Each function takes facts and gives a small result; ratios over nothing take the stated default. Groups are aggregated
partially before they are shuffled; sequences within a session are windows (a session is a day of one agent), those of an agent or
an entity, of any length, are segmented scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros
from . import scans

RUN_WARN, RUN_STOP = 3, 5


def ratio(a: Column, b: Column, default: float = 0.0, digits: int = 6) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default)), digits)


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def summary(cd: DataFrame, by: list[str]) -> DataFrame:
    """Headline figures of deliveries by any dimensions: tokens, savings, compression, cache and enrichment."""
    out = cd.groupBy(*by).agg(F.count("*").alias("deliveries"), F.sum("response_tokens").alias("delivered"), F.sum("baseline_tokens").alias("baseline"), F.sum("duration_ms").alias("latency_ms"), F.sum("cache_hit").alias("cache_hits"), F.sum("brain_enriched").alias("enriched"))
    saved = F.greatest(F.lit(0), F.col("baseline") - F.col("delivered"))
    return out.withColumns({"saved": saved, "compression": ratio(F.col("baseline"), F.col("delivered"), 1.0), "savings_pct": ratio(100 * saved, F.col("baseline"))})


def timeline(tc: DataFrame, cd: DataFrame) -> DataFrame:
    """day, calls, saved: two facts as one day series."""
    a = tc.groupBy(F.col("created_date").alias("day")).agg(F.count("*").alias("calls")).withColumn("saved", F.lit(0).cast("long"))
    b = cd.groupBy(F.col("created_date").alias("day")).agg(F.greatest(F.lit(0), F.sum(F.col("baseline_tokens") - F.col("response_tokens"))).alias("saved")).withColumn("calls", F.lit(0).cast("long"))
    return a.unionByName(b).groupBy("day").agg(F.sum("calls").alias("calls"), F.sum("saved").alias("saved"))


def tool_stats(tc: DataFrame, by: list[str]) -> DataFrame:
    return tc.groupBy(*by).agg(F.count("*").alias("calls"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.round(1 - F.avg("success"), 6).alias("error_rate"))


def agent_stats(s: DataFrame, cd: DataFrame) -> DataFrame:
    """Sessions and sums by agent, with distinct entities and tools of its deliveries (two-level, not correlated)."""
    a = s.groupBy("agent_id").agg(F.count("*").alias("sessions"), F.sum("tool_calls").alias("calls"), F.sum("tokens_saved").alias("saved"), F.sum("tasks_completed").alias("tasks"))
    b = cd.groupBy("agent_id").agg(F.countDistinct("entity").alias("entities"), F.countDistinct("tool_name").alias("tools"))
    return a.join(b, "agent_id", "left").na.fill(0, ["entities", "tools"])


def week_over_week(tc: DataFrame, last_day: Column) -> DataFrame:
    """tool_name, current, prior, delta, pct: the seven days to last_day against the seven before."""
    age = F.datediff(last_day, "created_date")
    out = tc.groupBy("tool_name").agg(count_if((age >= 0) & (age < 7)).alias("current"), count_if((age >= 7) & (age < 14)).alias("prior"))
    delta = F.col("current") - F.col("prior")
    return out.withColumns({"delta": delta, "pct": ratio(100 * delta, F.col("prior"))})


def declining(tc: DataFrame, last_day: Column, days: int = 14, least: int = 3) -> DataFrame:
    age, half = F.datediff(last_day, "created_date"), days // 2
    out = tc.groupBy("tool_name", "project_id").agg(count_if((age >= 0) & (age < half)).alias("recent"), count_if((age >= half) & (age < days)).alias("prior"))
    return out.where((F.col("prior") >= least) & (F.col("recent") < F.col("prior"))).withColumn("decline", ratio(F.col("prior") - F.col("recent"), F.col("prior")))


def nearest_rank(df: DataFrame, value: str, by: list[str], percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """pN: the smallest value that at least N per cent of rows do not exceed."""
    kind = df.schema[value].dataType
    return df.groupBy(*by).agg(*[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").cast(kind).alias(f"p{p}") for p in percents])


def offset_percentile(df: DataFrame, value: str, percents: tuple[int, ...] = (50, 90)) -> DataFrame:
    """pN: the value at place floor(n * N / 100), from 0, in order of a few grouped values: counts per value, not rows, are windowed."""
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("end", F.sum("k").over(w)).join(F.broadcast(counts.agg(F.sum("k").alias("n"))))
    return ranked.agg(*[F.min(F.when(F.col("end") > F.floor(F.col("n") * p / 100), F.col("v"))).alias(f"p{p}") for p in percents])


def adjacent_pairs(tc: DataFrame, keep: int = 20) -> DataFrame:
    """first, second, n: which call follows which within a session."""
    after = F.lead("tool_name").over(Window.partitionBy("session_id").orderBy("created_at", "id"))
    pairs = tc.select(F.col("tool_name").alias("first"), after.alias("second")).where("second is not null")
    return pairs.groupBy("first", "second").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "first", "second").limit(keep)


def error_recovery(tc: DataFrame) -> DataFrame:
    """Calls after a failed one in the same session, and how many of them succeed."""
    after = F.lead("success").over(Window.partitionBy("session_id").orderBy("created_at", "id"))
    pairs = tc.select("success", after.alias("next")).where("success = 0 and next is not null")
    return pairs.agg(F.count("*").alias("failures"), count_if(F.col("next") == 1).alias("recovered")).withColumn("rate", ratio(F.col("recovered"), F.col("failures")))


def repeated_runs(tc: DataFrame, pause: int = 60, window: int = 30) -> DataFrame:
    """Runs of the same call (tool and main argument) by an agent, and what a guard would do. Another call, or a pause of over a minute, ends
    a run; the guard looks back over `window` calls."""
    calls = tc.select("agent_id", "created_at", "id", F.concat_ws(":", "tool_name", "entity").alias("call"))
    placed = scans.with_previous(scans.chunks(calls, ["agent_id"], ["created_at", "id"], "calls"), ["agent_id"], {"call_before": "call", "before": "created_at"})
    gap = micros("created_at") - micros("before")
    new = F.col("call_before").isNull() | (F.col("call_before") != F.col("call")) | (gap > pause * 1_000_000)
    runs = scans.with_sum(placed, ["agent_id"], new.cast("long"), "run").groupBy("agent_id", "run").agg(F.least(F.count("*"), F.lit(window)).alias("length"))
    act = F.when(F.col("length") >= RUN_STOP, "stop").when(F.col("length") >= RUN_WARN, "warn").otherwise("pass")
    return runs.withColumn("action", act).groupBy("action").agg(F.count("*").alias("runs"), F.max("length").alias("longest"))


def refetches(cd: DataFrame) -> DataFrame:
    """agent_id, n, weight: requests for the same entity again, weighed by how soon."""
    from ..functions.scalars import refetch_weight

    before = F.lag("created_at").over(Window.partitionBy("agent_id", "entity").orderBy("created_at", "id"))
    gap = micros("created_at") - micros(before)
    hits = cd.select("agent_id", refetch_weight(gap / 1000000).alias("w")).where("w is not null")
    return hits.groupBy("agent_id").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("weight"))


def sessionized(tc: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """agent_id, session, start, end, calls: an agent's calls cut where it rests."""
    placed = scans.chunks(tc.select("agent_id", "created_at", "id"), ["agent_id"], ["created_at", "id"], "calls")
    placed = scans.with_previous(placed, ["agent_id"], {"before": "created_at"})
    rest = micros("created_at") - micros("before") > gap_minutes * 60_000_000
    marked = scans.with_sum(placed, ["agent_id"], F.coalesce(rest, F.lit(False)).cast("long"), "session")
    return marked.groupBy("agent_id", "session").agg(F.min("created_at").alias("start"), F.max("created_at").alias("end"), F.count("*").alias("calls"))


def workflow_adherence(tc: DataFrame) -> DataFrame:
    """Share of sessions that see a sign-up, a view and a purchase."""
    flags = tc.groupBy("session_id").agg(*[F.max((F.col("tool_name") == t).cast("int")).alias(t) for t in ("signup", "view", "purchase")])
    whole = (F.col("signup") + F.col("view") + F.col("purchase") == 3).cast("int")
    return flags.agg(F.count("*").alias("sessions"), F.sum(whole).alias("complete"), F.round(F.avg(whole), 6).alias("adherence"))


def resumed_sessions(s: DataFrame, hours: int = 24) -> DataFrame:
    """agent_id, resumed: sessions that start within so many hours of the end of another of the agent's."""
    ended = s.where("ended_at is not null").select(F.col("agent_id").alias("a"), F.col("session_id").alias("other"), "ended_at")
    near = (s["agent_id"] == ended["a"]) & (s["session_id"] != ended["other"]) & (ended["ended_at"] <= s["started_at"]) & (ended["ended_at"] >= s["started_at"] - F.expr(f"interval {hours} hours"))
    return s.select("agent_id", "session_id", "started_at").join(ended, near, "left_semi").groupBy("agent_id").agg(F.count("*").alias("resumed"))


def violations_without_view(tc: DataFrame) -> DataFrame:
    """Sessions with a purchase but no view before it, as a share of all (EXCEPT)."""
    buys = tc.where("tool_name = 'purchase'").groupBy("session_id").agg(F.min("created_at").alias("buy"))
    views = tc.where("tool_name = 'view'").groupBy("session_id").agg(F.min("created_at").alias("view"))
    fine = buys.join(views, "session_id").where("view < buy").select("session_id")
    bad = buys.select("session_id").exceptAll(fine).agg(F.count("*").alias("violations"))
    return bad.join(F.broadcast(tc.agg(F.countDistinct("session_id").alias("sessions")))).withColumn("rate", ratio(F.col("violations"), F.col("sessions")))


def discovery_effectiveness(tc: DataFrame) -> DataFrame:
    """Clicks that a purchase follows in the session, of all clicks."""
    later = Window.partitionBy("session_id").orderBy("created_at", "id").rowsBetween(1, Window.unboundedFollowing)
    bought = F.coalesce(F.max((F.col("tool_name") == "purchase").cast("int")).over(later), F.lit(0))
    marked = tc.withColumn("bought", bought).where("tool_name = 'click'")
    return marked.agg(F.count("*").alias("clicks"), F.sum("bought").alias("followed"), F.round(F.avg("bought"), 6).alias("rate"))


def entity_quality(os: DataFrame, last: Column) -> DataFrame:
    """entity, signals, quality, positive, negative; weights fade by e in thirty days."""
    fade = F.exp(-F.datediff(last, "created_date") / 30.0)
    weighed = os.withColumn("w", F.col("signal_weight") * fade)
    return weighed.groupBy("entity").agg(F.count("*").alias("signals"), F.round(F.sum("w"), 6).alias("quality"), count_if(F.col("signal_weight") > 0).alias("positive"), count_if(F.col("signal_weight") < 0).alias("negative"))


def first_context_right(cd: DataFrame, os: DataFrame) -> DataFrame:
    """1 - corrected (entity, session) pairs / delivered ones; 1 without any."""
    pairs = cd.select("entity", "session_id").distinct()
    wrong = os.where("signal_type = 'correction'").select("entity", "session_id").distinct()
    hit = pairs.join(wrong.withColumn("bad", F.lit(1)), ["entity", "session_id"], "left")
    return hit.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("bad"), F.lit(0)).alias("corrected")).withColumn("rate", F.round(1 - F.coalesce(F.try_divide(F.col("corrected"), F.col("pairs")), F.lit(0.0)), 6))


def context_precision(cd: DataFrame, os: DataFrame) -> DataFrame:
    """Of delivered entities by agent, those with a task done later; of tasks done, those with a delivery: semi joins."""
    done = os.where("signal_type = 'task_done'").select("agent_id", "entity").distinct()
    given = cd.select("agent_id", "entity").distinct()
    hits = given.join(done, ["agent_id", "entity"], "left_semi").agg(F.count("*").alias("hits"))
    n, m = given.agg(F.count("*").alias("delivered")), done.agg(F.count("*").alias("done"))
    p, r = ratio(F.col("hits"), F.col("delivered"), digits=12), ratio(F.col("hits"), F.col("done"), digits=12)
    all_ = hits.join(F.broadcast(n)).join(F.broadcast(m)).withColumns({"p": p, "r": r})
    return all_.select("hits", "delivered", "done", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")).alias("f1"))


def agent_overlap(tc: DataFrame, minutes: int = 60, keep: int = 50, named: int = 20) -> DataFrame:
    """entity, pairs, agents, agent_ids (the first `named`): how many pairs of agents worked on an entity at overlapping times, give or take so
    many minutes. A sweep over starts and ends counts them: a start overlaps all spans that are open; pairs are never listed."""
    spans = tc.groupBy("entity", "agent_id").agg(F.unix_micros(F.min("created_at").cast("timestamp")).alias("first"), (F.unix_micros(F.max("created_at").cast("timestamp")) + minutes * 60_000_000).alias("last"))
    marks = spans.select("entity", F.inline(F.array(F.struct(F.col("first").alias("t"), F.lit(0).alias("kind"), F.lit(1).alias("step")), F.struct(F.col("last").alias("t"), F.lit(1).alias("kind"), F.lit(-1).alias("step")))))
    swept = scans.with_sum(scans.chunks(marks, ["entity"], ["t", "kind"], "marks"), ["entity"], F.col("step"), "open", inclusive=False)
    pairs = swept.where("kind = 0").groupBy("entity").agg(F.sum("open").alias("pairs"))
    top = pairs.where("pairs > 0").orderBy(F.desc("pairs"), "entity").limit(keep)
    who = spans.join(F.broadcast(top.select("entity")), "entity", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy("agent_id")))
    ids = who.groupBy("entity").agg(F.count("*").alias("agents"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= named, F.col("agent_id")))), lambda x: x.cast("string")), ",").alias("agent_ids"))
    return top.join(ids, "entity")


def stale_deliveries(cd: DataFrame, os: DataFrame) -> DataFrame:
    """Deliveries of an entity that was corrected in the 24 hours before: those whose entity's last correction is that near. Deliveries and
    corrections of an entity are one order in time, scanned once; corrections come first among equals."""
    fix = os.where("signal_type = 'correction'").select("entity", "created_at", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("tool_name"))
    both = fix.unionByName(cd.select("entity", "created_at", F.lit(1).alias("kind"), "tool_name")).where("entity is not null and created_at is not null")
    placed = scans.with_max(scans.chunks(both, ["entity"], ["created_at", "kind"], "deliveries"), ["entity"], F.when(F.col("kind") == 0, F.col("created_at")), "fixed")
    return placed.where((F.col("kind") == 1) & (F.col("fixed") >= F.col("created_at") - F.expr("interval 24 hours"))).groupBy("tool_name").agg(F.count("*").alias("stale"))


def missing_days(tc: DataFrame, by: str = "project_id") -> DataFrame:
    """day: calendar days between the first and the last without a call by project (or agent)."""
    span = tc.groupBy(by).agg(F.min("created_date").alias("a"), F.max("created_date").alias("b"))
    days = span.select(by, F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(tc.select(by, F.col("created_date").alias("day")).distinct(), [by, "day"], "left_anti")


def hypothetical_cost(cd: DataFrame, prices: DataFrame) -> DataFrame:
    """By intent and model: what delivered and baseline tokens cost; prices(model, per_million) is a small dimension."""
    tokens = cd.groupBy("intent").agg(F.sum("response_tokens").alias("delivered"), F.sum("baseline_tokens").alias("baseline"))
    return tokens.crossJoin(F.broadcast(prices)).select("intent", "model", F.round(F.col("delivered") / 1e6 * F.col("per_million"), 6).alias("actual"), F.round(F.col("baseline") / 1e6 * F.col("per_million"), 6).alias("hypothetical"))


def learning_curve(s: DataFrame) -> DataFrame:
    """Per week: tasks a session and calls a task."""
    week = F.to_date(F.date_trunc("week", "started_at")).alias("week")
    out = s.groupBy(week).agg(F.count("*").alias("sessions"), F.sum("tasks_completed").alias("tasks"), F.sum("tool_calls").alias("calls"))
    return out.select("week", "sessions", ratio(F.col("tasks"), F.col("sessions")).alias("tasks_per_session"), ratio(F.col("calls"), F.col("tasks")).alias("calls_per_task"))


def first_sessions(s: DataFrame, n: int = 3) -> DataFrame:
    """An agent's first n sessions: calls a task."""
    rank = F.row_number().over(Window.partitionBy("agent_id").orderBy("started_at", "session_id"))
    first = s.withColumn("rank", rank).where(F.col("rank") <= n)
    return first.groupBy("agent_id").agg(F.sum("tool_calls").alias("calls"), F.sum("tasks_completed").alias("tasks")).withColumn("calls_per_task", ratio(F.col("calls"), F.col("tasks")))


def daily_rollup(tc: DataFrame, cd: DataFrame, os: DataFrame) -> DataFrame:
    """day, scope, scope_id, metric, value: the day's metrics for all, by project and by tool, in long form; one pass a fact."""
    stages = []
    for fact, prefix, metrics in (
        (tc, "calls", {"count": F.count("*"), "errors": count_if(F.col("success") == 0), "latency_ms": F.sum("duration_ms")}),
        (cd, "deliveries", {"count": F.count("*"), "delivered": F.sum("response_tokens"), "baseline": F.sum("baseline_tokens"), "cache_hits": F.sum("cache_hit")}),
        (os, "signals", {"count": F.count("*"), "done": count_if(F.col("signal_type") == "task_done")}),
    ):
        sets = fact.withColumn("scopes", F.array(F.struct(F.lit("all").alias("scope"), F.lit("").alias("scope_id")), F.struct(F.lit("project").alias("scope"), F.col("project_id").cast("string").alias("scope_id"))))
        wide = sets.select("*", F.inline("scopes")).groupBy(F.col("created_date").alias("day"), "scope", "scope_id").agg(*[m.cast("double").alias(f"{prefix}_{k}") for k, m in metrics.items()])
        stages.append(wide.unpivot(["day", "scope", "scope_id"], [f"{prefix}_{k}" for k in metrics], "metric", "value"))
    out = stages[0]
    for x in stages[1:]:
        out = out.unionByName(x)
    return out


def rollup_recomposed(rollup: DataFrame) -> DataFrame:
    """Rates per scope from summed parts of the long form (never averages of rates)."""
    wide = rollup.groupBy("scope", "scope_id").pivot("metric", ["calls_count", "calls_errors", "deliveries_delivered", "deliveries_baseline"]).agg(F.sum("value"))
    return wide.select("scope", "scope_id", ratio(F.col("calls_errors"), F.col("calls_count")).alias("error_rate"), ratio(F.col("deliveries_baseline"), F.col("deliveries_delivered"), 1.0).alias("compression"))
