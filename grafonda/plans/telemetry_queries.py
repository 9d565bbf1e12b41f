"""Telemetry analytics over the event stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import micros
from ..operators import handlers, model
from ..operators import telemetry as T
from ..operators.model import EVENT_SQL
from ..streaming import collector

QUERIES: dict = {}


_DAYS = {
    "summary_day": ("created_date",), "timeline": ("day",), "tool_timeline": ("created_date",), "missing_days": ("day",), "learning_curve": ("week",),
    "daily_rollup": ("day",), "concurrent_agents": ("day",), "peak_minute": ("created_date",),
}


def _add(name, run, sql):
    """Days are given as text, so that engines agree on their type."""

    def days_as_text(spark, d):
        out = run(spark, d)
        return out.withColumns({c: out[c].cast("string") for c, kind in out.dtypes if kind == "date"})

    found = _DAYS.get(name, ())
    cast = ", ".join(f"{c}::DATE::VARCHAR AS {c}" for c in found)
    QUERIES[f"tele_{name}"] = (days_as_text, f"WITH {EVENT_SQL} SELECT * REPLACE ({cast}) FROM ({sql})" if found else f"WITH {EVENT_SQL} {sql}")


def _facts(names):
    """Wraps a function of facts, named by letters, as one of (spark, sf_dir)."""
    make = {"tc": model.calls, "cd": model.deliveries, "s": model.sessions, "os": model.signals}

    def wrap(f):
        return lambda spark, d: f(*(make[n](spark, d) for n in names.split()))

    return wrap


def _last():
    """The day that counts as today; a Column needs a session, so it is made when a query runs."""
    return F.lit("2024-01-30").cast("date")


_SUM = "count(*) AS deliveries, sum(response_tokens)::BIGINT AS delivered, sum(baseline_tokens)::BIGINT AS baseline, sum(duration_ms)::BIGINT AS latency_ms, sum(cache_hit)::BIGINT AS cache_hits, sum(brain_enriched)::BIGINT AS enriched"
_SAVED = "greatest(0, baseline - delivered) AS saved, round(coalesce(baseline::DOUBLE / nullif(delivered, 0), 1.0), 6) AS compression, round(coalesce(100.0 * greatest(0, baseline - delivered)::DOUBLE / nullif(baseline, 0), 0), 6) AS savings_pct"
for _name, _by in {"summary_project": "project_id", "summary_agent": "agent_id", "summary_day": "created_date", "savings_by_intent": "intent", "summary_tool": "tool_name"}.items():
    _add(_name, _facts("cd")(lambda cd, by=_by: T.summary(cd, [by])), f"SELECT *, {_SAVED} FROM (SELECT {_by}, {_SUM} FROM cd GROUP BY 1)")
_add("summary_lifetime", _facts("cd")(lambda cd: T.summary(cd, [])), f"SELECT *, {_SAVED} FROM (SELECT {_SUM} FROM cd)")
_add("timeline", _facts("tc cd")(T.timeline), "SELECT coalesce(a.day, b.day) AS day, coalesce(calls, 0) AS calls, coalesce(saved, 0) AS saved FROM (SELECT created_date AS day, count(*) AS calls FROM tc GROUP BY 1) a FULL JOIN (SELECT created_date AS day, greatest(0, sum(baseline_tokens - response_tokens)::BIGINT) AS saved FROM cd GROUP BY 1) b ON a.day = b.day")
for _name, _by in {"tool_stats": "tool_name", "tool_timeline": "tool_name, created_date", "project_error_rates": "project_id", "tool_preferences": "agent_id, tool_name", "entity_calls": "entity"}.items():
    _add(_name, _facts("tc")(lambda tc, by=_by: T.tool_stats(tc, by.split(", "))), f"SELECT {_by}, count(*) AS calls, round(avg(duration_ms), 6) AS avg_ms, round(1 - avg(success), 6) AS error_rate FROM tc GROUP BY ALL")
_add("agent_stats", _facts("s cd")(T.agent_stats), "SELECT a.*, coalesce(entities, 0) AS entities, coalesce(tools, 0) AS tools FROM (SELECT agent_id, count(*) AS sessions, sum(tool_calls)::BIGINT AS calls, sum(tokens_saved)::BIGINT AS saved, sum(tasks_completed)::BIGINT AS tasks FROM s GROUP BY 1) a LEFT JOIN (SELECT agent_id, count(DISTINCT entity) AS entities, count(DISTINCT tool_name) AS tools FROM cd GROUP BY 1) b USING (agent_id)")
_AGE = "date_diff('day', created_date, DATE '2024-01-30')"
_add("week_over_week", _facts("tc")(lambda tc: T.week_over_week(tc, _last())), f"SELECT *, current - prior AS delta, round(coalesce(100.0 * (current - prior)::DOUBLE / nullif(prior, 0), 0), 6) AS pct FROM (SELECT tool_name, count(*) FILTER ({_AGE} BETWEEN 0 AND 6) AS current, count(*) FILTER ({_AGE} BETWEEN 7 AND 13) AS prior FROM tc GROUP BY 1)")
_add("declining_tools", _facts("tc")(lambda tc: T.declining(tc, _last())), f"SELECT *, round((prior - recent)::DOUBLE / prior, 6) AS decline FROM (SELECT tool_name, project_id, count(*) FILTER ({_AGE} BETWEEN 0 AND 6) AS recent, count(*) FILTER ({_AGE} BETWEEN 7 AND 13) AS prior FROM tc GROUP BY ALL) WHERE prior >= 3 AND recent < prior")
_add("latency_percentiles", _facts("tc")(lambda tc: T.nearest_rank(tc, "duration_ms", ["tool_name"])), "SELECT tool_name, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99 FROM tc GROUP BY 1")
_add("calls_per_session", _facts("s")(lambda s: T.offset_percentile(s, "tool_calls")), "SELECT (SELECT tool_calls FROM s ORDER BY 1 LIMIT 1 OFFSET (SELECT count(*) * 50 // 100 FROM s)) AS p50, (SELECT tool_calls FROM s ORDER BY 1 LIMIT 1 OFFSET (SELECT count(*) * 90 // 100 FROM s)) AS p90")
_PAIR = "(SELECT tool_name AS first, lead(tool_name) OVER (PARTITION BY session_id ORDER BY created_at, id) AS second FROM tc)"
_add("tool_pairs", _facts("tc")(T.adjacent_pairs), f"SELECT first, second, count(*) AS n FROM {_PAIR} WHERE second IS NOT NULL GROUP BY ALL ORDER BY n DESC, first, second LIMIT 20")
_add("error_recovery", _facts("tc")(T.error_recovery), "SELECT count(*) AS failures, count(*) FILTER (nx = 1) AS recovered, round(coalesce(count(*) FILTER (nx = 1)::DOUBLE / nullif(count(*), 0), 0), 6) AS rate FROM (SELECT success, lead(success) OVER (PARTITION BY session_id ORDER BY created_at, id) AS nx FROM tc) WHERE success = 0 AND nx IS NOT NULL")
_RUNS = (
    "ca AS (SELECT agent_id, created_at, id, concat_ws(':', tool_name, entity) AS call, epoch_us(created_at) - epoch_us(lag(created_at) OVER w) AS gap, lag(concat_ws(':', tool_name, entity)) OVER w AS before FROM tc WINDOW w AS (PARTITION BY agent_id ORDER BY created_at, id)), "
    "ru AS (SELECT agent_id, sum(CASE WHEN before IS NULL OR before <> call OR gap > 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY created_at, id) AS run FROM ca)"
)
_add("repeated_runs", _facts("tc")(lambda tc: T.repeated_runs(tc.withColumns({"agent_id": F.col("project_id"), "entity": F.lit("x"), "created_at": F.date_trunc("hour", "created_at")}))), "SELECT CASE WHEN length >= 5 THEN 'stop' WHEN length >= 3 THEN 'warn' ELSE 'pass' END AS action, count(*) AS runs, max(length) AS longest FROM (WITH " + _RUNS.replace("SELECT agent_id, created_at, id, concat_ws(':', tool_name, entity) AS call", "SELECT agent_id, created_at, id, tool_name AS call").replace("lag(concat_ws(':', tool_name, entity)) OVER w", "lag(tool_name) OVER w").replace("FROM tc WINDOW", "FROM (SELECT project_id AS agent_id, date_trunc('hour', created_at) AS created_at, id, tool_name FROM tc) WINDOW") + " SELECT least(count(*), 30) AS length FROM ru GROUP BY agent_id, run) GROUP BY 1")
_add("refetches", _facts("cd")(lambda cd: T.refetches(cd.withColumns({"agent_id": F.col("project_id"), "entity": F.col("tool_name")}))), "SELECT agent_id, count(*) AS n, round(sum(CASE WHEN gap < 300 THEN -0.5 ELSE -0.2 END), 6)::DOUBLE AS weight FROM (SELECT project_id AS agent_id, (epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY project_id, tool_name ORDER BY created_at, id))) / 1000000.0 AS gap FROM cd) WHERE gap < 1800 GROUP BY 1")
_add("sessionized", _facts("tc")(T.sessionized), "SELECT agent_id, session::BIGINT AS session, min(created_at) AS start, max(created_at) AS \"end\", count(*) AS calls FROM (SELECT *, sum(CASE WHEN gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY agent_id ORDER BY created_at, id)) AS gap FROM tc)) GROUP BY ALL")
_add("workflow_adherence", _facts("tc")(T.workflow_adherence), "SELECT count(*) AS sessions, sum(w)::BIGINT AS complete, round(avg(w), 6) AS adherence FROM (SELECT session_id, CASE WHEN count(DISTINCT tool_name) FILTER (tool_name IN ('signup', 'view', 'purchase')) = 3 THEN 1 ELSE 0 END AS w FROM tc GROUP BY 1)")
_add("resumed_sessions", _facts("s")(T.resumed_sessions), "SELECT agent_id, count(*) AS resumed FROM s WHERE EXISTS (SELECT 1 FROM s o WHERE o.agent_id = s.agent_id AND o.session_id <> s.session_id AND o.ended_at <= s.started_at AND o.ended_at >= s.started_at - INTERVAL 24 HOUR) GROUP BY 1")
_add("workflow_violations", _facts("tc")(T.violations_without_view), "SELECT violations, sessions, round(violations::DOUBLE / sessions, 6) AS rate FROM (SELECT count(*) AS violations FROM (SELECT session_id, min(created_at) FILTER (tool_name = 'purchase') AS b, min(created_at) FILTER (tool_name = 'view') AS v FROM tc GROUP BY 1) WHERE b IS NOT NULL AND (v IS NULL OR v >= b)), (SELECT count(DISTINCT session_id) AS sessions FROM tc)")
_add("discovery", _facts("tc")(T.discovery_effectiveness), "SELECT count(*) AS clicks, sum(b)::BIGINT AS followed, round(avg(b), 6) AS rate FROM (SELECT tool_name, coalesce(max((tool_name = 'purchase')::INT) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS b FROM tc) WHERE tool_name = 'click'")
_add("entity_quality", _facts("os")(lambda os: T.entity_quality(os, _last())), f"SELECT entity, count(*) AS signals, round(sum(signal_weight * exp(-{_AGE} / 30.0)), 6) AS quality, count(*) FILTER (signal_weight > 0) AS positive, count(*) FILTER (signal_weight < 0) AS negative FROM os GROUP BY 1")
_add("first_context_right", _facts("cd os")(T.first_context_right), "SELECT count(*) AS pairs, count(o.entity) AS corrected, round(1 - coalesce(count(o.entity)::DOUBLE / nullif(count(*), 0), 0), 6) AS rate FROM (SELECT DISTINCT entity, session_id FROM cd) c LEFT JOIN (SELECT DISTINCT entity, session_id FROM os WHERE signal_type = 'correction') o USING (entity, session_id)")
_add("context_precision", _facts("cd os")(T.context_precision), "SELECT hits, delivered, done, round(hits::DOUBLE / delivered, 6) AS precision, round(hits::DOUBLE / done, 6) AS recall, round(2.0 * hits / (delivered + done), 6) AS f1 FROM (SELECT (SELECT count(*) FROM (SELECT agent_id, entity FROM cd INTERSECT SELECT agent_id, entity FROM os WHERE signal_type = 'task_done')) AS hits, (SELECT count(*) FROM (SELECT DISTINCT agent_id, entity FROM cd)) AS delivered, (SELECT count(*) FROM (SELECT DISTINCT agent_id, entity FROM os WHERE signal_type = 'task_done')) AS done)")
_add("agent_overlap", _facts("tc")(T.agent_overlap), "SELECT entity, pairs, agents, agent_ids FROM (SELECT a.entity, count(*) AS pairs FROM (SELECT entity, agent_id, min(created_at) f, max(created_at) l FROM tc GROUP BY ALL) a JOIN (SELECT entity, agent_id, min(created_at) f, max(created_at) l FROM tc GROUP BY ALL) b ON a.entity = b.entity AND a.agent_id < b.agent_id AND a.f <= b.l + INTERVAL 60 MINUTE AND b.f <= a.l + INTERVAL 60 MINUTE GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) JOIN (SELECT entity, count(*) AS agents, array_to_string(list_sort(list(agent_id))[1:20], ',') AS agent_ids FROM (SELECT DISTINCT entity, agent_id FROM tc) GROUP BY 1) USING (entity)")
_add("stale_deliveries", _facts("cd os")(T.stale_deliveries), "SELECT tool_name, count(*) AS stale FROM cd WHERE EXISTS (SELECT 1 FROM os WHERE signal_type = 'correction' AND os.entity = cd.entity AND os.created_at <= cd.created_at AND os.created_at >= cd.created_at - INTERVAL 24 HOUR) GROUP BY 1")
_add("missing_days", _facts("tc")(lambda tc: T.missing_days(tc, "agent_id")), "SELECT agent_id, day FROM (SELECT agent_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM (SELECT agent_id, min(created_date) a, max(created_date) b FROM tc GROUP BY 1)) EXCEPT SELECT agent_id, created_date FROM tc")
_add("learning_curve", _facts("s")(T.learning_curve), "SELECT date_trunc('week', started_at)::DATE AS week, count(*) AS sessions, round(sum(tasks_completed)::DOUBLE / count(*), 6) AS tasks_per_session, round(coalesce(sum(tool_calls)::DOUBLE / nullif(sum(tasks_completed), 0), 0), 6) AS calls_per_task FROM s GROUP BY 1")
_add("first_sessions", _facts("s")(T.first_sessions), "SELECT agent_id, sum(tool_calls)::BIGINT AS calls, sum(tasks_completed)::BIGINT AS tasks, round(coalesce(sum(tool_calls)::DOUBLE / nullif(sum(tasks_completed), 0), 0), 6) AS calls_per_task FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY started_at, session_id) AS r FROM s) WHERE r <= 3 GROUP BY 1")
_LONG = """SELECT day, scope, scope_id, metric, value FROM (
 SELECT created_date AS day, p.scope, p.scope_id, m.metric, sum(m.value)::DOUBLE AS value FROM (
  SELECT created_date, project_id, unnest([{'metric': 'calls_count', 'value': 1}, {'metric': 'calls_errors', 'value': 1 - success}, {'metric': 'calls_latency_ms', 'value': duration_ms}]) AS m FROM tc
  UNION ALL SELECT created_date, project_id, unnest([{'metric': 'deliveries_count', 'value': 1}, {'metric': 'deliveries_delivered', 'value': response_tokens}, {'metric': 'deliveries_baseline', 'value': baseline_tokens}, {'metric': 'deliveries_cache_hits', 'value': cache_hit}]) FROM cd
  UNION ALL SELECT created_date, project_id, unnest([{'metric': 'signals_count', 'value': 1}, {'metric': 'signals_done', 'value': (signal_type = 'task_done')::INT}]) FROM os) f,
  LATERAL (SELECT unnest([{'scope': 'all', 'scope_id': ''}, {'scope': 'project', 'scope_id': project_id::VARCHAR}]) AS p) GROUP BY ALL)"""
_add("daily_rollup", _facts("tc cd os")(T.daily_rollup), _LONG)
_add("rollup_recomposed", _facts("tc cd os")(lambda tc, cd, os: T.rollup_recomposed(T.daily_rollup(tc, cd, os))), f"SELECT scope, scope_id, round(sum(value) FILTER (metric = 'calls_errors') / sum(value) FILTER (metric = 'calls_count'), 6) AS error_rate, round(sum(value) FILTER (metric = 'deliveries_baseline') / sum(value) FILTER (metric = 'deliveries_delivered'), 6) AS compression FROM ({_LONG}) GROUP BY ALL")


def _simple(name, facts, run, sql):
    _add(name, _facts(facts)(run), sql)


_simple("session_duration", "s", lambda s: s.where("ended_at is not null").agg(F.round(F.avg((micros("ended_at") - micros("started_at")) / 1000), 3).alias("avg_ms"), F.count("*").alias("ended")), "SELECT round(avg((epoch_us(ended_at) - epoch_us(started_at)) / 1000.0), 3) AS avg_ms, count(*) AS ended FROM s WHERE ended_at IS NOT NULL")
_simple("tasks_per_hour", "s", lambda s: s.where("ended_at is not null").agg(T.ratio(F.sum("tasks_completed"), F.sum(micros("ended_at") - micros("started_at")) / 3.6e9).alias("rate")), "SELECT round(sum(tasks_completed) / (sum(epoch_us(ended_at) - epoch_us(started_at)) / 3.6e9), 6) AS rate FROM s WHERE ended_at IS NOT NULL")
_simple("clean_sessions", "s", lambda s: s.agg(F.count("*").alias("sessions"), T.count_if(F.col("ended_at").isNotNull()).alias("ended")).withColumn("rate", T.ratio(F.col("ended"), F.col("sessions"))), "SELECT count(*) AS sessions, count(ended_at) AS ended, round(count(ended_at)::DOUBLE / count(*), 6) AS rate FROM s")
_simple("cost_by_model", "s", lambda s: s.groupBy(scalars.without_model_date(F.col("model")).alias("model")).agg(F.count("*").alias("sessions"), F.sum("tokens_saved").alias("saved")), "SELECT regexp_replace(model, '-(\\d{8}|\\d{4}-\\d{2}-\\d{2})$', '') AS model, count(*) AS sessions, sum(tokens_saved)::BIGINT AS saved FROM s GROUP BY 1")
_simple("agent_efficiency", "s", lambda s: s.groupBy("agent_id").agg(T.ratio(F.sum("tokens_saved"), F.sum("tool_calls")).alias("saved_per_call"), T.ratio(F.sum("tasks_completed"), F.count("*")).alias("tasks_per_session")), "SELECT agent_id, round(coalesce(sum(tokens_saved)::DOUBLE / nullif(sum(tool_calls), 0), 0), 6) AS saved_per_call, round(sum(tasks_completed)::DOUBLE / count(*), 6) AS tasks_per_session FROM s GROUP BY 1")
_simple("context_reuse", "cd", lambda cd: cd.groupBy("entity", "session_id").agg(F.count("*").alias("n")).agg(T.count_if(F.col("n") > 1).alias("reused"), F.sum("n").alias("rows")).withColumn("rate", T.ratio(F.col("reused"), F.col("rows"))), "SELECT count(*) FILTER (n > 1) AS reused, sum(n)::BIGINT AS rows, round(count(*) FILTER (n > 1)::DOUBLE / sum(n), 6) AS rate FROM (SELECT count(*) AS n FROM cd GROUP BY entity, session_id)")
_simple("campaigns", "s", lambda s: s.groupBy("agent_id").agg(F.count("*").alias("sessions")).where("sessions > 1"), "SELECT agent_id, count(*) AS sessions FROM s GROUP BY 1 HAVING count(*) > 1")
_simple("concurrent_agents", "tc", lambda tc: tc.groupBy(F.col("created_date").alias("day")).agg(F.countDistinct("agent_id").alias("agents")), "SELECT created_date AS day, count(DISTINCT agent_id) AS agents FROM tc GROUP BY 1")
_simple("enrichment_uplift", "cd", lambda cd: cd.agg(F.avg(F.when(F.col("brain_enriched") == 1, F.col("baseline_tokens") - F.col("response_tokens"))).alias("a"), F.avg(F.when(F.col("brain_enriched") == 0, F.col("baseline_tokens") - F.col("response_tokens"))).alias("b")).select(F.round(F.col("a") / F.col("b") - 1, 6).alias("uplift")), "SELECT round(avg(baseline_tokens - response_tokens) FILTER (brain_enriched = 1) / avg(baseline_tokens - response_tokens) FILTER (brain_enriched = 0) - 1, 6) AS uplift FROM cd")
_simple("top_entities", "cd", lambda cd: cd.groupBy("entity").agg(F.count("*").alias("n"), F.sum(F.col("baseline_tokens") - F.col("response_tokens")).alias("saved")).orderBy(F.desc("n"), F.desc("saved"), "entity").limit(10), "SELECT entity, count(*) AS n, sum(baseline_tokens - response_tokens)::BIGINT AS saved FROM cd GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
_simple("onboarding_latency", "tc", lambda tc: tc.groupBy("session_id").agg(F.min(F.when(F.col("tool_name") == "view", micros("created_at"))).alias("v"), F.min(F.when(F.col("tool_name") == "signup", micros("created_at"))).alias("i")).where("v >= i").agg(F.count("*").alias("sessions"), F.round(F.avg((F.col("v") - F.col("i")) / 1000), 3).alias("avg_ms")), "SELECT count(*) AS sessions, round(avg((v - i) / 1000.0), 3) AS avg_ms FROM (SELECT epoch_us(min(created_at) FILTER (tool_name = 'view')) v, epoch_us(min(created_at) FILTER (tool_name = 'signup')) i FROM tc GROUP BY session_id) WHERE v >= i")
_simple("channel_win_rates", "cd", lambda cd: cd.groupBy("intent").agg(F.sum("cache_hit").alias("hits")).join(F.broadcast(cd.agg(F.sum("cache_hit").alias("n")))).select("intent", "hits", T.ratio(F.col("hits"), F.col("n")).alias("share")), "SELECT intent, sum(cache_hit)::BIGINT AS hits, round(sum(cache_hit)::DOUBLE / (SELECT sum(cache_hit) FROM cd), 6) AS share FROM cd GROUP BY 1")
_simple("engagement", "s", lambda s: s.agg(T.ratio(F.sum(10 * F.col("tasks_completed") + 2 * F.col("tool_calls")), F.count("*")).alias("score")), "SELECT round(sum(10 * tasks_completed + 2 * tool_calls)::DOUBLE / count(*), 6) AS score FROM s")
_simple("failure_free_sessions", "tc", lambda tc: tc.where("tool_name = 'view'").select("session_id").distinct().join(tc.where("success = 0").select("session_id").distinct(), "session_id", "left_anti").agg(F.count("*").alias("clean")), "SELECT count(*) AS clean FROM (SELECT DISTINCT session_id FROM tc WHERE tool_name = 'view') WHERE session_id NOT IN (SELECT session_id FROM tc WHERE success = 0)")
_simple("monthly_roi", "cd", lambda cd: cd.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.sum("baseline_tokens").alias("baseline"), F.sum("response_tokens").alias("delivered"), F.count("*").alias("deliveries")), "SELECT strftime(created_at, '%Y-%m') AS month, sum(baseline_tokens)::BIGINT AS baseline, sum(response_tokens)::BIGINT AS delivered, count(*) AS deliveries FROM cd GROUP BY 1")
_simple("hourly_activity", "tc", lambda tc: tc.groupBy(F.window("created_at", "1 hour").start.alias("hour")).agg(F.count("*").alias("calls"), F.countDistinct("agent_id").alias("agents")), "SELECT date_trunc('hour', created_at) AS hour, count(*) AS calls, count(DISTINCT agent_id) AS agents FROM tc GROUP BY 1")
_simple("peak_minute", "tc", lambda tc: tc.groupBy("created_date", F.date_trunc("minute", "created_at").alias("m")).agg(F.count("*").alias("n")).groupBy("created_date").agg(F.max("n").alias("peak")), "SELECT created_date, max(n) AS peak FROM (SELECT created_date, date_trunc('minute', created_at) m, count(*) n FROM tc GROUP BY ALL) GROUP BY 1")
_add("hypothetical_cost", lambda spark, d: T.hypothetical_cost(model.deliveries(spark, d), spark.createDataFrame([("small", 0.5), ("large", 15.0)], "model string, per_million double")), "SELECT intent, model, round(sum(response_tokens) / 1e6 * per_million, 6) AS actual, round(sum(baseline_tokens) / 1e6 * per_million, 6) AS hypothetical FROM cd, (VALUES ('small', 0.5::DOUBLE), ('large', 15.0::DOUBLE)) p(model, per_million) GROUP BY intent, model, per_million")
_simple("event_counts", "tc", lambda tc: tc.agg(*[T.count_if(F.col("tool_name") == t).alias(t) for t in ("view", "click", "purchase", "signup", "error")]), "SELECT " + ", ".join(f"count(*) FILTER (tool_name = '{t}') AS {t}" for t in ("view", "click", "purchase", "signup", "error")) + " FROM tc")
_simple("signal_distribution", "os", lambda os: os.groupBy("project_id", "signal_type").agg(F.count("*").alias("n"), F.sum("signal_weight").alias("weight")), "SELECT project_id, signal_type, count(*) AS n, sum(signal_weight) AS weight FROM os GROUP BY ALL")
_simple("decay_effectiveness", "cd", lambda cd: cd.withColumn("age", F.datediff(_last(), "created_date")).groupBy(F.when(F.col("age") < 7, "fresh").when(F.col("age") <= 30, "month").otherwise("old").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("cache_hit"), 6).alias("hit_rate")), f"SELECT CASE WHEN {_AGE} < 7 THEN 'fresh' WHEN {_AGE} <= 30 THEN 'month' ELSE 'old' END AS bucket, count(*) AS n, round(avg(cache_hit), 6) AS hit_rate FROM cd GROUP BY 1")
_simple("session_detail", "tc", lambda tc: tc.groupBy("session_id").agg(F.count("*").alias("calls"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "tool_name"))), lambda x: x["tool_name"]), ">").alias("sequence")), "SELECT session_id, count(*) AS calls, string_agg(tool_name, '>' ORDER BY created_at, id) AS sequence FROM tc GROUP BY 1")
_simple("tools_per_session", "tc", lambda tc: T.offset_percentile(tc.groupBy("session_id").agg(F.countDistinct("tool_name").alias("n")), "n"), "SELECT (SELECT n FROM t ORDER BY 1 LIMIT 1 OFFSET (SELECT count(*) * 50 // 100 FROM t)) AS p50, (SELECT n FROM t ORDER BY 1 LIMIT 1 OFFSET (SELECT count(*) * 90 // 100 FROM t)) AS p90 FROM (SELECT 1) one, (SELECT 1) two".replace("FROM t ", "FROM (SELECT count(DISTINCT tool_name) AS n FROM tc GROUP BY session_id) t ").replace("FROM t)", "FROM (SELECT count(DISTINCT tool_name) AS n FROM tc GROUP BY session_id) t)"))
_simple("task_completion", "os", lambda os: os.where("signal_type = 'task_done'").groupBy("session_id").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("avg_done"), F.max("n").alias("most")), "SELECT round(avg(n), 6) AS avg_done, max(n) AS most FROM (SELECT count(*) AS n FROM os WHERE signal_type = 'task_done' GROUP BY session_id)")
_simple("latest_delivery", "cd", lambda cd: cd.groupBy("entity").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("at")), "SELECT entity, arg_max(id, (epoch_us(created_at), id)) AS id, max(created_at) AS at FROM cd GROUP BY 1")
_simple("calls_after_delivery", "cd tc", lambda cd, tc: cd.groupBy("agent_id").agg(F.min("created_at").alias("first")).join(tc.select("agent_id", "created_at"), "agent_id").where("created_at > first").groupBy("agent_id").agg(F.count("*").alias("later")), "SELECT agent_id, count(*) AS later FROM tc JOIN (SELECT agent_id, min(created_at) AS first FROM cd GROUP BY 1) USING (agent_id) WHERE created_at > first GROUP BY 1")
_simple("open_sessions", "s", lambda s: s.where("ended_at is null").groupBy("agent_id").agg(F.count("*").alias("open"), F.sum("tool_calls").alias("calls")), "SELECT agent_id, count(*) AS open, sum(tool_calls)::BIGINT AS calls FROM s WHERE ended_at IS NULL GROUP BY 1")
_simple("validate_verify_funnel", "tc", lambda tc: tc.groupBy("session_id").agg(F.max((F.col("tool_name") == "click").cast("int")).alias("a"), F.max((F.col("tool_name") == "purchase").cast("int")).alias("b")).agg(F.sum("a").alias("clicked"), F.sum(F.col("a") * F.col("b")).alias("bought")).withColumn("rate", T.ratio(F.col("bought"), F.col("clicked"))), "SELECT clicked, bought, round(bought::DOUBLE / clicked, 6) AS rate FROM (SELECT sum(a)::BIGINT AS clicked, sum(a * b)::BIGINT AS bought FROM (SELECT max((tool_name = 'click')::INT) a, max((tool_name = 'purchase')::INT) b FROM tc GROUP BY session_id))")
_simple("search_modes", "cd", lambda cd: cd.groupBy("intent", "tool_name").agg(F.count("*").alias("n"), F.round(F.avg("cache_hit"), 6).alias("cache_rate")).orderBy(F.desc("n"), "intent", "tool_name").limit(5), "SELECT intent, tool_name, count(*) AS n, round(avg(cache_hit), 6) AS cache_rate FROM cd GROUP BY ALL ORDER BY n DESC, intent, tool_name LIMIT 5")
_simple("memory_coverage", "cd os", lambda cd, os: cd.select("entity").distinct().join(os.select("entity").distinct().withColumn("hit", F.lit(1)), "entity", "left").agg(F.count("*").alias("entities"), F.count("hit").alias("covered")), "SELECT count(*) AS entities, count(o.entity) AS covered FROM (SELECT DISTINCT entity FROM cd) c LEFT JOIN (SELECT DISTINCT entity FROM os) o USING (entity)")
_simple("session_gap", "s", lambda s: s.withColumn("before", F.lag("ended_at").over(Window.partitionBy("agent_id").orderBy("started_at", "session_id"))).where("before is not null").agg(F.count("*").alias("gaps"), F.round(F.avg((micros("started_at") - micros("before")) / 3.6e9), 6).alias("avg_hours")), "SELECT count(*) AS gaps, round(avg((epoch_us(started_at) - epoch_us(b)) / 3.6e9), 6) AS avg_hours FROM (SELECT started_at, lag(ended_at) OVER (PARTITION BY agent_id ORDER BY started_at, session_id) AS b FROM s) WHERE b IS NOT NULL")


def _flushes(spark, d):
    """Events as they pass a ring of 20 for each type, a day at a time."""
    return collector.collected(model.table(spark, d, "events"), "event_type", "event_id", "ts", capacity=20, seconds=86400)


_COUNTED = (
    "ev AS (SELECT event_type AS source, event_id, epoch_ms(ts) AS ms, epoch_ms(ts) // 86400000 AS interval, row_number() OVER w AS r, count(*) OVER (PARTITION BY event_type, epoch_ms(ts) // 86400000) AS m FROM events WINDOW w AS (PARTITION BY event_type, epoch_ms(ts) // 86400000 ORDER BY epoch_ms(ts), event_id)), "
    "fl AS (SELECT source, interval, kind, count(*)::INT AS n, string_agg(event_id, ',' ORDER BY ms, event_id) AS ids, any_value(m) AS m FROM (SELECT *, CASE WHEN m >= 16 AND r <= 16 THEN 'early' ELSE 'timer' END AS kind FROM ev WHERE m < 16 OR r <= 16 OR r > m - 20) GROUP BY 1, 2, 3), "
    "co AS (SELECT *, sum(CASE WHEN kind = 'early' THEN 16 WHEN m >= 16 THEN m - 16 ELSE m END) OVER w::BIGINT AS enqueued, sum(CASE WHEN kind = 'timer' THEN greatest(0, m - 36) ELSE 0 END) OVER w::BIGINT AS dropped, "
    "max(CASE WHEN kind = 'early' THEN 16 WHEN m < 16 THEN m ELSE greatest(16, least(m - 16, 20)) END) OVER w::BIGINT AS high_water FROM fl WINDOW w AS (PARTITION BY source ORDER BY interval, kind ROWS UNBOUNDED PRECEDING))"
)
QUERIES["tele_collected"] = (lambda spark, d: _flushes(spark, d).select("source", "interval", "kind", "n", F.array_join("ids", ",").alias("ids"), "enqueued", "dropped", "high_water"), f"WITH {_COUNTED} SELECT source, interval, kind, n, ids, enqueued, dropped, high_water FROM co")
QUERIES["tele_drop_rates"] = (lambda spark, d: collector.drop_rates(_flushes(spark, d)).select("source", "enqueued", "dropped", "high_water", "drop_rate"), f"WITH {_COUNTED} SELECT source, max(enqueued) AS enqueued, max(dropped) AS dropped, max(high_water) AS high_water, round(max(dropped)::DOUBLE / max(enqueued), 6) AS drop_rate FROM co GROUP BY 1")


# --- what a session's tools answer
def _session_start(tc, s, os):
    messages = tc.where("tool_name in ('signup', 'view')").selectExpr("if(tool_name = 'signup', null, agent_id) as to_agent", "if(id % 2 = 0, created_at, null) as read_at")
    tasks = os.selectExpr("agent_id", "if(signal_type = 'task_done', 'done', 'pending') as status")
    return handlers.session_start(tc, s, tasks, messages, os.where("signal_type = 'correction'"), F.lit("2024-01-20").cast("timestamp"), 240)


_add(
    "session_start", _facts("tc s os")(_session_start),
    "SELECT agent_id, coalesce(p, 0) AS pending_tasks, coalesce(u, 0) + (SELECT count(*) FROM tc WHERE tool_name = 'signup' AND id % 2 <> 0) AS unread, r AS session_resumed, (SELECT count(DISTINCT agent_id) FROM s WHERE ended_at IS NULL AND started_at <= TIMESTAMP '2024-01-20') - coalesce(b, 0) AS other_agents, f AS last_failure "
    "FROM (SELECT DISTINCT agent_id FROM tc) LEFT JOIN (SELECT agent_id, count(*) AS p FROM os WHERE signal_type <> 'task_done' GROUP BY 1) USING (agent_id) LEFT JOIN (SELECT agent_id, count(*) AS u FROM tc WHERE tool_name = 'view' AND id % 2 <> 0 GROUP BY 1) USING (agent_id) "
    "LEFT JOIN (SELECT agent_id, arg_max(session_id, started_at) AS r FROM s WHERE ended_at IS NULL AND started_at <= TIMESTAMP '2024-01-20' AND started_at > TIMESTAMP '2024-01-10' GROUP BY 1) USING (agent_id) LEFT JOIN (SELECT DISTINCT agent_id, 1 AS b FROM s WHERE ended_at IS NULL AND started_at <= TIMESTAMP '2024-01-20') USING (agent_id) "
    "LEFT JOIN (SELECT agent_id, max_by(entity, (created_at, entity)) AS f FROM os WHERE signal_type = 'correction' AND created_at <= TIMESTAMP '2024-01-20' GROUP BY 1) USING (agent_id)",
)
_add(
    "my_analytics", _facts("tc cd s os")(lambda tc, cd, s, os: handlers.my_analytics(tc, cd, s, os, _last())),
    "SELECT agent_id, tool_calls, coalesce(d, 0) AS deliveries, coalesce(v, 0)::BIGINT AS tokens_saved, coalesce(n, 0) AS sessions, coalesce(k, 0)::BIGINT AS tasks_completed, round(coalesce(h::DOUBLE / nullif(d, 0), 0), 6) AS cache_hit_rate, avg_latency_ms, round(coalesce(100.0 * v / nullif(bt, 0), 0), 6)::DOUBLE AS savings_pct, weakest "
    "FROM (SELECT agent_id, count(*) AS tool_calls, round(avg(duration_ms), 4) AS avg_latency_ms FROM tc WHERE created_date > DATE '2024-01-23' AND created_date <= DATE '2024-01-30' GROUP BY 1) "
    "LEFT JOIN (SELECT agent_id, count(*) AS d, sum(baseline_tokens) AS bt, greatest(0, sum(baseline_tokens) - sum(response_tokens)) AS v, sum(cache_hit) AS h FROM cd WHERE created_date > DATE '2024-01-23' AND created_date <= DATE '2024-01-30' GROUP BY 1) USING (agent_id) "
    "LEFT JOIN (SELECT agent_id, count(*) AS n, sum(tasks_completed) AS k FROM s WHERE started_at::DATE > DATE '2024-01-23' AND started_at::DATE <= DATE '2024-01-30' GROUP BY 1) USING (agent_id) "
    "LEFT JOIN (SELECT agent_id, arg_min(entity, (-n, entity)) AS weakest FROM (SELECT agent_id, entity, count(*) AS n FROM os WHERE signal_type = 'correction' AND created_date > DATE '2024-01-23' AND created_date <= DATE '2024-01-30' GROUP BY 1, 2) GROUP BY 1) USING (agent_id)",
)
_add(
    "session_end", _facts("tc s os")(handlers.session_end),
    "SELECT session_id, minutes, calls, failed, tools, coalesce(entities, '') AS entities, coalesce(done, 0) AS tasks_done, coalesce(bad, 0) AS corrections, next_step FROM (SELECT session_id, round((epoch_us(ended_at) - epoch_us(started_at)) / 60000000, 4) AS minutes FROM s WHERE ended_at IS NOT NULL) "
    "JOIN (SELECT session_id, count(*) AS calls, count(*) FILTER (success = 0) AS failed, string_agg(DISTINCT tool_name, ',' ORDER BY tool_name) AS tools FROM tc GROUP BY 1) USING (session_id) "
    "LEFT JOIN (SELECT session_id, string_agg(entity, ',' ORDER BY r) AS entities FROM (SELECT session_id, entity, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, entity) AS r FROM tc WHERE entity IS NOT NULL GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1) USING (session_id) "
    "LEFT JOIN (SELECT session_id, count(*) FILTER (signal_type = 'task_done') AS done, count(*) FILTER (signal_type = 'correction') AS bad, CASE WHEN arg_max(signal_type, (created_at, id)) = 'correction' THEN arg_max(entity, (created_at, id)) END AS next_step FROM os GROUP BY 1) USING (session_id)",
)
