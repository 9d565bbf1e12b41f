"""Counters, shares and comparisons over telemetry facts: tc (calls), cd (deliveries), s (sessions), os (signals), each one pass with partial
sums; shares are 0 where there is nothing to divide by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros, without_model_date
from .telemetry import count_if, ratio

# The metrics that are compared week by week.
WEEKLY = (
    "calls_count calls_errors calls_busy_ms deliveries_count deliveries_delivered deliveries_baseline deliveries_saved deliveries_cache_hits deliveries_enriched deliveries_truncated deliveries_entities "
    "sessions_count sessions_ended sessions_calls sessions_saved sessions_tasks signals_count signals_done signals_corrections agents_active entities_called tools_used projects_active "
    "views clicks purchases signups slow_calls fast_calls first_calls reopened"
).split()


def by_day(facts: DataFrame, by: list[str], day: str = "created_date", **conditions: Column) -> DataFrame:
    """day, *by and how many rows of each day meet each condition."""
    return facts.groupBy(F.col(day).alias("day"), *by).agg(*[count_if(c).alias(n) for n, c in conditions.items()])


def sums_by_day(facts: DataFrame, day: str = "created_date", **values: Column) -> DataFrame:
    return facts.groupBy(F.col(day).alias("day")).agg(*[F.sum(v).alias(n) for n, v in values.items()])


def delivery_counters(cd: DataFrame) -> DataFrame:
    """day, truncated, cache_hits, cached_saving: by day."""
    saving = F.when(F.col("cache_hit") == 1, F.greatest(F.col("baseline_tokens") - F.col("response_tokens"), F.lit(0))).otherwise(0)
    return sums_by_day(cd, truncated=F.col("truncated"), cache_hits=F.col("cache_hit"), cached_saving=saving)


def hit_distribution(facts: DataFrame, ids: Column, keep: int = 10) -> DataFrame:
    """id, hits of a column of JSON arrays of ids; the most frequent ones."""
    each = facts.select(F.explode(F.from_json(ids, "array<string>")).alias("id"))
    return each.groupBy("id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "id").limit(keep)


def latest(facts: DataFrame, value: str, at: str = "created_at", order: str = "id") -> DataFrame:
    """One row: the last time and the value then."""
    return facts.agg(F.max(at).alias("at"), F.max_by(value, F.struct(at, order)).alias("value"))


def coverage(total: DataFrame, stale: Column) -> DataFrame:
    """One row: n, stale and the share that is not stale."""
    return total.agg(F.count("*").alias("n"), count_if(stale).alias("stale")).withColumn("fresh_pct", F.round(100 * (1 - F.col("stale") / F.nullif(F.col("n"), F.lit(0))), 6))


def outcome_shares(facts: DataFrame, by: list[str], good: Column) -> DataFrame:
    return facts.groupBy(*by).agg(F.count("*").alias("n"), count_if(good).alias("good")).withColumn("rate", ratio(F.col("good"), F.col("n")))


def recall_reuse(calls: DataFrame, hit: Column, cross: Column) -> DataFrame:
    """One row: hits, cross-session hits, misses, and the share of cross-session hits among all."""
    out = calls.agg(count_if(hit & ~cross).alias("hits"), count_if(hit & cross).alias("cross"), count_if(~hit).alias("misses"))
    return out.withColumn("reuse", ratio(F.col("cross"), F.col("hits") + F.col("cross") + F.col("misses")))


def session_effectiveness(cd: DataFrame) -> DataFrame:
    """session_id, deliveries, first_fetches, hit_rate, saved: a first fetch is an entity's first delivery in a session."""
    first = F.row_number().over(Window.partitionBy("session_id", "entity").orderBy("created_at", "id"))
    saved = F.greatest(F.col("baseline_tokens") - F.col("response_tokens"), F.lit(0))
    return cd.withColumn("k", first).groupBy("session_id").agg(F.count("*").alias("deliveries"), count_if(F.col("k") == 1).alias("first_fetches"), F.round(F.avg("cache_hit"), 6).alias("hit_rate"), F.sum(saved).alias("saved"))


def effectiveness_trend(cd: DataFrame) -> DataFrame:
    """day, hit_rate, saved."""
    return cd.groupBy(F.col("created_date").alias("day")).agg(F.round(F.avg("cache_hit"), 6).alias("hit_rate"), F.sum(F.greatest(F.col("baseline_tokens") - F.col("response_tokens"), F.lit(0))).alias("saved"))


def time_to_outcome(cd: DataFrame, os: DataFrame) -> DataFrame:
    """signal_type, n, avg_ms: from the first delivery in a session to its signals, where that is after it."""
    first = cd.groupBy("session_id").agg(F.min("created_at").alias("first"))
    gap = (micros("created_at") - micros("first")) / 1000
    return os.join(first, "session_id").withColumn("gap", gap).where("gap > 0").groupBy("signal_type").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 3).alias("avg_ms"))


def budget_hits(cd: DataFrame, budget: int) -> DataFrame:
    """intent, n, hits, rate: deliveries that used up their budget."""
    return outcome_shares(cd, ["intent"], F.col("response_tokens") >= budget)


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage(model, ...) with per_million: the price of the model, or of its name without a date, or null."""
    p = prices.select(F.col("model").alias("m"), "per_million")
    exact = usage.join(F.broadcast(p), F.col("model") == F.col("m"), "left").drop("m").withColumnRenamed("per_million", "exact")  # a price list has a row for each model
    loose = exact.join(F.broadcast(p), without_model_date(F.col("model")) == F.col("m"), "left").drop("m")
    return loose.withColumn("per_million", F.coalesce("exact", "per_million")).drop("exact")


def price_history(prices: DataFrame) -> DataFrame:
    """model, per_million, since, until of price rows (model, per_million, at): a row for each change."""
    w = Window.partitionBy("model").orderBy("at")
    changed = prices.withColumn("old", F.lag("per_million").over(w)).where(F.col("old").isNull() | (F.col("old") != F.col("per_million")))
    return changed.select("model", "per_million", F.col("at").alias("since"), F.lead("at").over(w).alias("until"))


def usage_by(usage: DataFrame, by: list[str]) -> DataFrame:
    """*by, calls, tokens, cost of usage(tokens, per_million, ...)."""
    return usage.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") / 1e6 * F.coalesce("per_million", F.lit(0.0))), 6).alias("cost"))


def model_efficiency(s: DataFrame, usage: DataFrame, corrected: bool = False) -> DataFrame:
    """model, sessions, saved, tokens over sessions and their usage(session_id, tokens). A session with several usage rows counts its saved
    tokens once for each, as reports have always had it; corrected counts them once."""
    per = usage.groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    both = s.join(per, "session_id", "left")
    times = F.lit(1) if corrected else F.greatest(F.coalesce("rows", F.lit(1)), F.lit(1))
    return both.groupBy("model").agg(F.count("*").alias("sessions"), F.sum(F.col("tokens_saved") * times).alias("saved"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def top_of_day(facts: DataFrame, value: str, keep: int = 5, day: str = "created_date") -> DataFrame:
    """day, value, n, rank: the most frequent values of each day."""
    counted = facts.groupBy(F.col(day).alias("day"), value).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), value))).where(F.col("rank") <= keep)


def complexity_outcome(tc: DataFrame, s: DataFrame, step: str) -> DataFrame:
    """replans, sessions, avg_tasks: how many tasks sessions finish by how often they planned again."""
    plans = tc.where(F.col("tool_name") == step).groupBy("session_id").agg(F.count("*").alias("plans"))
    both = s.join(plans, "session_id", "left").withColumn("replans", F.greatest(F.coalesce("plans", F.lit(0)) - 1, F.lit(0)))
    return both.groupBy("replans").agg(F.count("*").alias("sessions"), F.round(F.avg("tasks_completed"), 6).alias("avg_tasks"))


def freshness(entities: DataFrame, changed: DataFrame) -> DataFrame:
    """One row: entities, fresh (those whose text holds a changed file) and their share. Files are looked up by the words of an entity's text,
    not by holding every entity against every file."""
    whole = entities.select("entity").distinct()
    word = whole.select("entity", F.explode(F.split("entity", r"[^\w./-]+")).alias("file")).where("file <> ''")
    hit = word.join(changed.select("file").distinct(), "file", "left_semi").select("entity").distinct().withColumn("hit", F.lit(1))
    return whole.join(hit, "entity", "left").agg(F.count("*").alias("entities"), F.count("hit").alias("fresh")).withColumn("rate", ratio(F.col("fresh"), F.col("entities")))


def volume(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: calls, sessions, per_session."""
    return calls.agg(F.count("*").alias("calls")).join(F.broadcast(sessions.agg(F.count("*").alias("sessions")))).withColumn("per_session", ratio(F.col("calls"), F.col("sessions")))


def cost_timeline(tc: DataFrame, cd: DataFrame, per_million: float) -> DataFrame:
    """day, calls, saved (at least 0), cost, compression (1 without deliveries)."""
    calls = tc.select(F.col("created_date").alias("day"), F.lit(1).alias("calls"), F.lit(0).alias("base"), F.lit(0).alias("sent"))
    sent = cd.select(F.col("created_date").alias("day"), F.lit(0).alias("calls"), F.col("baseline_tokens").alias("base"), F.col("response_tokens").alias("sent"))
    out = calls.unionByName(sent).groupBy("day").agg(*[F.sum(c).alias(c) for c in ("calls", "base", "sent")])
    return out.select("day", "calls", F.greatest(F.col("base") - F.col("sent"), F.lit(0)).alias("saved"), F.round(F.col("sent") / 1e6 * per_million, 9).alias("cost"), F.round(F.when(F.col("sent") > 0, F.col("base") / F.col("sent")).otherwise(1.0), 6).alias("compression"))


def metrics_of_day(tc: DataFrame, cd: DataFrame, s: DataFrame, os: DataFrame) -> DataFrame:
    """day, metric, value: the metrics of WEEKLY, a row for each that a day has. Facts are added up by day before they meet."""
    call = tc.groupBy(F.col("created_date").alias("day")).agg(
        F.count("*").alias("calls_count"), count_if(F.col("success") == 0).alias("calls_errors"), F.sum("duration_ms").alias("calls_busy_ms"), F.countDistinct("agent_id").alias("agents_active"),
        F.countDistinct("entity").alias("entities_called"), F.countDistinct("tool_name").alias("tools_used"), F.countDistinct("project_id").alias("projects_active"),
        *[count_if(F.col("tool_name") == t).alias(f"{t}s") for t in ("view", "click", "purchase", "signup")], count_if(F.col("duration_ms") >= 1000).alias("slow_calls"), count_if(F.col("duration_ms") < 100).alias("fast_calls"),
    )
    sent = cd.groupBy(F.col("created_date").alias("day")).agg(
        F.count("*").alias("deliveries_count"), F.sum("response_tokens").alias("deliveries_delivered"), F.sum("baseline_tokens").alias("deliveries_baseline"), F.sum(F.greatest(F.col("baseline_tokens") - F.col("response_tokens"), F.lit(0))).alias("deliveries_saved"),
        F.sum("cache_hit").alias("deliveries_cache_hits"), F.sum("brain_enriched").alias("deliveries_enriched"), F.sum("truncated").alias("deliveries_truncated"), F.countDistinct("entity").alias("deliveries_entities"),
    )
    order = Window.partitionBy("agent_id").orderBy("started_at", "session_id")
    ranked = s.withColumn("k", F.row_number().over(order))
    held = ranked.groupBy(F.to_date("started_at").alias("day")).agg(
        F.count("*").alias("sessions_count"), F.count("ended_at").alias("sessions_ended"), F.sum("tool_calls").alias("sessions_calls"), F.sum("tokens_saved").alias("sessions_saved"), F.sum("tasks_completed").alias("sessions_tasks"),
        count_if(F.col("k") == 1).alias("first_calls"), count_if(F.col("k") > 1).alias("reopened"),
    )
    said = os.groupBy(F.col("created_date").alias("day")).agg(F.count("*").alias("signals_count"), count_if(F.col("signal_type") == "task_done").alias("signals_done"), count_if(F.col("signal_type") == "correction").alias("signals_corrections"))
    out = None
    for df in (call, sent, held, said):
        long = df.select("day", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns if c != "day"])))
        out = long if out is None else out.unionByName(long)
    return out


def weekly(metrics: DataFrame, last: Column) -> DataFrame:
    """metric, current, prior, delta, pct: two weeks up to last of a roll-up (day, metric, value); pct is 0 where the prior week has nothing."""
    age = F.datediff(last, F.col("day"))
    week = lambda a, b: F.coalesce(F.sum(F.when((age >= a) & (age <= b), F.col("value"))), F.lit(0.0))
    out = metrics.where(F.col("metric").isin(*WEEKLY)).groupBy("metric").agg(week(0, 6).alias("current"), week(7, 13).alias("prior"))
    return out.withColumn("delta", F.col("current") - F.col("prior")).withColumn("pct", F.round(F.when(F.col("prior") == 0, 0.0).otherwise(100 * F.col("delta") / F.col("prior")), 6))


def scoped_rollup(tc: DataFrame, cd: DataFrame) -> DataFrame:
    """day, scope, scope_id, metric, value: calls, errors and busy time by day for all, each project, agent and tool in one pass, and deliveries
    by intent."""
    scopes = F.array(*[F.struct(F.lit(k).alias("scope"), v.cast("string").alias("scope_id")) for k, v in (("all", F.lit("")), ("project", F.col("project_id")), ("agent", F.col("agent_id")), ("tool", F.col("tool_name")))])
    calls = tc.select(F.col("created_date").alias("day"), F.inline(scopes), "success", "duration_ms").groupBy("day", "scope", "scope_id").agg(F.count("*").alias("calls"), count_if(F.col("success") == 0).alias("errors"), F.sum("duration_ms").alias("busy_ms"))
    sent = cd.groupBy(F.col("created_date").alias("day"), F.lit("intent").alias("scope"), F.col("intent").alias("scope_id")).agg(F.count("*").alias("deliveries"), F.sum("response_tokens").alias("delivered"))
    long = lambda df, names: df.select("day", "scope", "scope_id", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))
    return long(calls, ("calls", "errors", "busy_ms")).unionByName(long(sent, ("deliveries", "delivered")))


def backfilled(days: DataFrame, rolled: DataFrame) -> DataFrame:
    """Days that have facts but no roll-up."""
    return days.select("day").distinct().join(rolled.select("day").distinct(), "day", "left_anti")
