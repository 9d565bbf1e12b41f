"""Further analytics over the event stream's facts: day counters, shares, prices, comparisons and scoped roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import micros
from ..operators import coordination
from ..operators import counters as C
from ..operators import telemetry as T
from ..operators.model import EVENT_SQL
from ..sources import sinks
from .telemetry_queries import _facts

QUERIES: dict = {}


def _add(name, facts, run, sql, days=()):
    """days: columns of dates, given as text so that engines agree on their type."""
    f = _facts(facts)(run)

    def as_text(spark, d):
        out = f(spark, d)
        return out.withColumns({c: out[c].cast("string") for c in days}) if days else out

    cast = ", ".join(f"{c}::DATE::VARCHAR AS {c}" for c in days)
    QUERIES[f"tele_{name}"] = (as_text, f"WITH RECURSIVE {EVENT_SQL} " + (f"SELECT * REPLACE ({cast}) FROM ({sql})" if days else sql))


_LAST = "2024-01-30"
_add("day_counters", "tc", lambda tc: C.by_day(tc, ["project_id"], guards=F.col("tool_name") == "error", memory_ops=F.col("tool_name") == "view", validations=F.col("tool_name") == "click", errors=F.col("success") == 0), "SELECT created_date AS day, project_id, count(*) FILTER (tool_name = 'error') AS guards, count(*) FILTER (tool_name = 'view') AS memory_ops, count(*) FILTER (tool_name = 'click') AS validations, count(*) FILTER (success = 0) AS errors FROM tc GROUP BY ALL", ("day",))
_add("day_costs", "cd", lambda cd: C.sums_by_day(cd, brain=F.col("response_tokens") * F.col("brain_enriched"), agent=F.col("response_tokens")), "SELECT created_date AS day, sum(response_tokens * brain_enriched)::BIGINT AS brain, sum(response_tokens)::BIGINT AS agent FROM cd GROUP BY 1", ("day",))
_add("delivery_counters", "cd", C.delivery_counters, "SELECT created_date AS day, sum(truncated)::BIGINT AS truncated, sum(cache_hit)::BIGINT AS cache_hits, sum(CASE WHEN cache_hit = 1 THEN greatest(baseline_tokens - response_tokens, 0) ELSE 0 END)::BIGINT AS cached_saving FROM cd GROUP BY 1", ("day",))
_add("rule_hits", "tc", lambda tc: C.hit_distribution(tc, F.concat(F.lit('["r'), (F.col("id") % 7).cast("string"), F.lit('", "s'), (F.col("id") % 3).cast("string"), F.lit('"]')), 5), "SELECT id, count(*) AS hits FROM (SELECT unnest(['r' || (id % 7), 's' || (id % 3)]) AS id FROM tc) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
_add("latest_status", "tc", lambda tc: C.latest(tc, "tool_name").withColumn("at", micros("at")), "SELECT epoch_us(max(created_at)) AS at, arg_max(tool_name, (epoch_us(created_at), id)) AS value FROM tc")
_add("embedding_coverage", "tc", lambda tc: C.coverage(tc, F.col("id") % 9 == 0), "SELECT count(*) AS n, count(*) FILTER (id % 9 = 0) AS stale, round(100 * (1 - count(*) FILTER (id % 9 = 0)::DOUBLE / count(*)), 6) AS fresh_pct FROM tc")
_add("cross_session_recall", "cd", lambda cd: C.recall_reuse(cd, F.col("cache_hit") == 1, F.col("id") % 2 == 0), "SELECT count(*) FILTER (cache_hit = 1 AND id % 2 <> 0) AS hits, count(*) FILTER (cache_hit = 1 AND id % 2 = 0) AS \"cross\", count(*) FILTER (cache_hit <> 1) AS misses, round(count(*) FILTER (cache_hit = 1 AND id % 2 = 0)::DOUBLE / count(*), 6) AS reuse FROM cd")
_add("filtered_counters", "tc", lambda tc: tc.agg(F.round(F.avg(F.when(F.col("tool_name") == "click", F.col("duration_ms"))), 6).alias("avg_rebuild_ms"), T.count_if(F.col("tool_name") == "signup").alias("detections"), F.sum(F.when(F.col("tool_name") == "view", F.col("id") % 3)).alias("invalidated")), "SELECT round(avg(duration_ms) FILTER (tool_name = 'click'), 6) AS avg_rebuild_ms, count(*) FILTER (tool_name = 'signup') AS detections, sum(id % 3) FILTER (tool_name = 'view')::BIGINT AS invalidated FROM tc")
_add("delivery_outcomes", "cd", lambda cd: C.outcome_shares(cd, ["intent"], F.col("id") % 5 < 3), "SELECT intent, count(*) AS n, count(*) FILTER (id % 5 < 3) AS good, round(count(*) FILTER (id % 5 < 3)::DOUBLE / count(*), 6) AS rate FROM cd GROUP BY 1")
_add("session_effectiveness", "cd", C.session_effectiveness, "SELECT session_id, count(*) AS deliveries, count(DISTINCT entity) AS first_fetches, round(avg(cache_hit), 6) AS hit_rate, sum(greatest(baseline_tokens - response_tokens, 0))::BIGINT AS saved FROM cd GROUP BY 1")
_add("effectiveness_trend", "cd", C.effectiveness_trend, "SELECT created_date AS day, round(avg(cache_hit), 6) AS hit_rate, sum(greatest(baseline_tokens - response_tokens, 0))::BIGINT AS saved FROM cd GROUP BY 1", ("day",))
_add("cache_hit_rate", "tc cd os", lambda tc, cd, os: T.daily_rollup(tc, cd, os).where("scope = 'all'").agg(T.ratio(F.sum(F.when(F.col("metric") == "deliveries_cache_hits", F.col("value"))), F.sum(F.when(F.col("metric") == "deliveries_count", F.col("value")))).alias("rate")), "SELECT round(sum(cache_hit)::DOUBLE / count(*), 6) AS rate FROM cd")
_DUR = "(SELECT ((epoch_us(ended_at) - epoch_us(started_at)) // 60000000)::BIGINT AS n FROM s WHERE ended_at IS NOT NULL)"
_AT = ", ".join(f"(SELECT n FROM {_DUR} ORDER BY 1 LIMIT 1 OFFSET (SELECT count(*) * {p} // 100 FROM {_DUR})) AS p{p}" for p in (50, 90, 95))
_add("duration_distribution", "s", lambda s: T.offset_percentile(s.where("ended_at is not null").select(F.floor((micros("ended_at") - micros("started_at")) / 60_000_000).alias("n")), "n", (50, 90, 95)), f"SELECT {_AT}")
_add("time_to_outcome", "cd os", C.time_to_outcome, "SELECT signal_type, count(*) AS n, round(avg(gap), 3) AS avg_ms FROM (SELECT signal_type, (epoch_us(created_at) - epoch_us(first)) / 1000.0 AS gap FROM os JOIN (SELECT session_id, min(created_at) AS first FROM cd GROUP BY 1) USING (session_id)) WHERE gap > 0 GROUP BY 1")
_add("budget_hits", "cd", lambda cd: C.budget_hits(cd, 1200), "SELECT intent, count(*) AS n, count(*) FILTER (response_tokens >= 1200) AS good, round(count(*) FILTER (response_tokens >= 1200)::DOUBLE / count(*), 6) AS rate FROM cd GROUP BY 1")


def _usage(s, cd):
    return cd.join(s.select("session_id", "model"), "session_id").select("session_id", "model", F.col("response_tokens").alias("tokens"))


def _prices(df):
    return df.sparkSession.createDataFrame([("model-0", 2.0), ("model-2-20240115", 5.0)], "model string, per_million double")


_PRICE = "us AS (SELECT session_id, model, response_tokens AS tokens FROM cd JOIN (SELECT session_id, model FROM s) USING (session_id)), pr AS (SELECT *, CASE WHEN model IN ('model-0', 'model-0-20240115') THEN 2.0 WHEN model = 'model-2-20240115' THEN 5.0 END AS per_million FROM us)"
_add("priced_usage", "s cd", lambda s, cd: C.usage_by(C.priced(_usage(s, cd), _prices(s)), ["model"]), f"SELECT model, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(tokens / 1e6 * coalesce(per_million, 0)), 6)::DOUBLE AS cost FROM (WITH {_PRICE} SELECT * FROM pr) GROUP BY 1")
_add("price_history", "tc", lambda tc: C.price_history(tc.select(F.col("tool_name").alias("model"), (F.col("duration_ms") / 1500).cast("int").alias("per_million"), F.col("id").alias("at"))).na.fill(-1, ["until"]), "SELECT model, per_million, t AS since, coalesce(lead(t) OVER (PARTITION BY model ORDER BY t), -1) AS until FROM (SELECT *, lag(per_million) OVER (PARTITION BY model ORDER BY t) AS old FROM (SELECT tool_name AS model, (duration_ms // 1500)::INT AS per_million, id AS t FROM tc)) WHERE old IS NULL OR old <> per_million")
_EFF = "SELECT model, count(*) AS sessions, sum(tokens_saved * {0})::BIGINT AS saved, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM s LEFT JOIN (SELECT session_id, sum(response_tokens) AS tokens, count(*) AS n FROM cd GROUP BY 1) USING (session_id) GROUP BY 1"
_add("model_efficiency", "s cd", lambda s, cd: C.model_efficiency(s, _usage(s, cd)), _EFF.format("greatest(coalesce(n, 1), 1)"))
_add("model_efficiency_corrected", "s cd", lambda s, cd: C.model_efficiency(s, _usage(s, cd), True), _EFF.format("1"))
_add("top_tools_of_day", "tc", lambda tc: C.top_of_day(tc, "tool_name", 2), "SELECT * FROM (SELECT created_date AS day, tool_name, count(*) AS n, row_number() OVER (PARTITION BY created_date ORDER BY count(*) DESC, tool_name)::INT AS rank FROM tc GROUP BY 1, 2) WHERE rank <= 2", ("day",))
_add("plan_complexity", "tc s", lambda tc, s: C.complexity_outcome(tc, s, "view"), "SELECT greatest(coalesce(p, 0) - 1, 0) AS replans, count(*) AS sessions, round(avg(tasks_completed), 6) AS avg_tasks FROM s LEFT JOIN (SELECT session_id, count(*) AS p FROM tc WHERE tool_name = 'view' GROUP BY 1) USING (session_id) GROUP BY 1")
_add("graph_freshness", "cd tc", lambda cd, tc: C.freshness(cd.select(F.concat(F.lit("pkg f"), "entity", F.lit(".go")).alias("entity")), tc.where("tool_name = 'error'").select(F.concat(F.lit("f"), "entity", F.lit(".go")).alias("file"))), "SELECT count(DISTINCT entity) AS entities, count(DISTINCT entity) FILTER (entity IN (SELECT entity FROM tc WHERE tool_name = 'error')) AS fresh, round(count(DISTINCT entity) FILTER (entity IN (SELECT entity FROM tc WHERE tool_name = 'error'))::DOUBLE / count(DISTINCT entity), 6) AS rate FROM cd")
_add("message_volume", "tc s", lambda tc, s: C.volume(tc.where("tool_name = 'click'"), s), "SELECT count(*) AS calls, (SELECT count(*) FROM s) AS sessions, round(count(*)::DOUBLE / (SELECT count(*) FROM s), 6) AS per_session FROM tc WHERE tool_name = 'click'")
_add("cost_timeline", "tc cd", lambda tc, cd: C.cost_timeline(tc, cd, 3.0), "SELECT day, sum(calls)::BIGINT AS calls, greatest(sum(base) - sum(sent), 0)::BIGINT AS saved, round(sum(sent) / 1e6 * 3.0, 9)::DOUBLE AS cost, round(CASE WHEN sum(sent) > 0 THEN sum(base)::DOUBLE / sum(sent) ELSE 1.0 END, 6) AS compression FROM (SELECT created_date AS day, 1 AS calls, 0 AS base, 0 AS sent FROM tc UNION ALL SELECT created_date, 0, baseline_tokens, response_tokens FROM cd) GROUP BY 1", ("day",))
_METRICS = """m AS (
  SELECT day, unnest(map_entries(mp)) AS e FROM (
    SELECT created_date AS day, MAP {'calls_count': count(*)::DOUBLE, 'calls_errors': count(*) FILTER (success = 0)::DOUBLE, 'calls_busy_ms': sum(duration_ms)::DOUBLE, 'agents_active': count(DISTINCT agent_id)::DOUBLE, 'entities_called': count(DISTINCT entity)::DOUBLE, 'tools_used': count(DISTINCT tool_name)::DOUBLE, 'projects_active': count(DISTINCT project_id)::DOUBLE,
      'views': count(*) FILTER (tool_name = 'view')::DOUBLE, 'clicks': count(*) FILTER (tool_name = 'click')::DOUBLE, 'purchases': count(*) FILTER (tool_name = 'purchase')::DOUBLE, 'signups': count(*) FILTER (tool_name = 'signup')::DOUBLE, 'slow_calls': count(*) FILTER (duration_ms >= 1000)::DOUBLE, 'fast_calls': count(*) FILTER (duration_ms < 100)::DOUBLE} AS mp FROM tc GROUP BY 1
    UNION ALL SELECT created_date, MAP {'deliveries_count': count(*)::DOUBLE, 'deliveries_delivered': sum(response_tokens)::DOUBLE, 'deliveries_baseline': sum(baseline_tokens)::DOUBLE, 'deliveries_saved': sum(greatest(baseline_tokens - response_tokens, 0))::DOUBLE, 'deliveries_cache_hits': sum(cache_hit)::DOUBLE, 'deliveries_enriched': sum(brain_enriched)::DOUBLE, 'deliveries_truncated': sum(truncated)::DOUBLE, 'deliveries_entities': count(DISTINCT entity)::DOUBLE} FROM cd GROUP BY 1
    UNION ALL SELECT started_at::DATE, MAP {'sessions_count': count(*)::DOUBLE, 'sessions_ended': count(ended_at)::DOUBLE, 'sessions_calls': sum(tool_calls)::DOUBLE, 'sessions_saved': sum(tokens_saved)::DOUBLE, 'sessions_tasks': sum(tasks_completed)::DOUBLE, 'first_calls': count(*) FILTER (k = 1)::DOUBLE, 'reopened': count(*) FILTER (k > 1)::DOUBLE} FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY started_at, session_id) AS k FROM s) GROUP BY 1
    UNION ALL SELECT created_date, MAP {'signals_count': count(*)::DOUBLE, 'signals_done': count(*) FILTER (signal_type = 'task_done')::DOUBLE, 'signals_corrections': count(*) FILTER (signal_type = 'correction')::DOUBLE} FROM os GROUP BY 1))"""
_add("metrics_of_day", "tc cd s os", C.metrics_of_day, f"SELECT day, e.key AS metric, e.value AS value FROM (WITH {_METRICS} SELECT * FROM m)", ("day",))
_WK = "coalesce(sum(e.value) FILTER (date_diff('day', day, DATE '2024-01-30') BETWEEN {0} AND {1}), 0)"
_add("weekly_metrics", "tc cd s os", lambda tc, cd, s, os: C.weekly(C.metrics_of_day(tc, cd, s, os), F.lit(_LAST).cast("date")), f"SELECT *, current - prior AS delta, round(CASE WHEN prior = 0 THEN 0 ELSE 100 * (current - prior) / prior END, 6) AS pct FROM (SELECT e.key AS metric, {_WK.format(0, 6)} AS current, {_WK.format(7, 13)} AS prior FROM (WITH {_METRICS} SELECT * FROM m) GROUP BY 1)")
_SC = "[{'scope': 'all', 'scope_id': ''}, {'scope': 'project', 'scope_id': project_id::VARCHAR}, {'scope': 'agent', 'scope_id': agent_id::VARCHAR}, {'scope': 'tool', 'scope_id': tool_name}]"
_add(
    "scoped_rollup", "tc cd", C.scoped_rollup,
    f"SELECT day, x.scope AS scope, x.scope_id AS scope_id, unnest(['calls', 'errors', 'busy_ms']) AS metric, unnest([c, er, bu]) AS value FROM (SELECT day, x, count(*)::DOUBLE AS c, count(*) FILTER (success = 0)::DOUBLE AS er, sum(duration_ms)::DOUBLE AS bu FROM (SELECT created_date AS day, unnest({_SC}) AS x, success, duration_ms FROM tc) GROUP BY ALL) "
    "UNION ALL SELECT created_date, 'intent', intent, unnest(['deliveries', 'delivered']), unnest([count(*)::DOUBLE, sum(response_tokens)::DOUBLE]) FROM cd GROUP BY 1, 3",
    ("day",),
)
_add("backfilled_days", "tc", lambda tc: C.backfilled(tc.select(F.col("created_date").alias("day")), tc.where("day(created_date) % 2 = 0").select(F.col("created_date").alias("day"))), "SELECT DISTINCT created_date AS day FROM tc WHERE day(created_date) % 2 <> 0", ("day",))
_add("raw_export", "tc cd s os", lambda tc, cd, s, os: sinks.export_summary(sinks.json_rows(tool_calls=tc, context_deliveries=cd, sessions=s, outcome_signals=os)), "SELECT 'tool_calls' AS kind, count(*) AS n FROM tc UNION ALL SELECT 'context_deliveries', count(*) FROM cd UNION ALL SELECT 'sessions', count(*) FROM s UNION ALL SELECT 'outcome_signals', count(*) FROM os")
_add("report", "tc", lambda tc: sinks.report_lines(tc.groupBy(F.col("tool_name").alias("name")).agg(F.count("*").cast("double").alias("value")), "Calls"), "SELECT place::INT AS place, line FROM (SELECT 0 AS place, '# Calls' AS line UNION ALL SELECT 1, '| metric | value |' UNION ALL SELECT 2, '|-|-|' UNION ALL SELECT row_number() OVER (ORDER BY tool_name) + 2, '| ' || tool_name || ' | ' || format('{:,.4f}', count(*)::DOUBLE) || ' |' FROM tc GROUP BY tool_name)")
_add("session_chain", "tc", lambda tc: coordination.session_chain(tc, ["agent_id"], "created_at").select("agent_id", "number", "calls", "state", F.coalesce("parent", F.lit(-1)).alias("parent")), "SELECT agent_id, number, count(*) AS calls, CASE WHEN number = 0 THEN 'new' WHEN arg_min(gap, (epoch_us(created_at), -coalesce(gap, 0))) <= 86400 THEN 'resumed' ELSE 'superseded' END AS state, number - 1 AS parent FROM (SELECT *, sum(CASE WHEN gap > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY created_at)::BIGINT AS number FROM (SELECT agent_id, created_at, floor(epoch_us(created_at) / 1000000)::BIGINT - floor(epoch_us(lag(created_at) OVER (PARTITION BY agent_id ORDER BY created_at)) / 1000000)::BIGINT AS gap FROM tc)) GROUP BY agent_id, number")
_add("stale_sessions", "s", lambda s: coordination.stale_sessions(s.withColumn("last_seen_at", F.col("started_at")), F.lit("2024-02-01").cast("timestamp"), 60, 5).select("session_id", "idle_minutes"), "SELECT session_id, ((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(started_at)) // 60000000)::BIGINT AS idle_minutes FROM s WHERE ended_at IS NULL AND (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(started_at)) // 60000000 > 60 ORDER BY 2 DESC, 1 LIMIT 5")
_add("call_summary", "tc", lambda tc: coordination.call_summary(tc, "agent_id", 3), "SELECT agent_id, any_value(calls) AS calls, any_value(er) AS error_rate, any_value(busy) AS busy_ms, string_agg(tool_name || ':' || n, ',' ORDER BY r) AS tools FROM (SELECT agent_id, tool_name, count(*) AS n, row_number() OVER (PARTITION BY agent_id ORDER BY count(*) DESC, tool_name) AS r FROM tc GROUP BY 1, 2) JOIN (SELECT agent_id, count(*) AS calls, round(1 - avg(success), 6) AS er, sum(duration_ms)::BIGINT AS busy FROM tc GROUP BY 1) USING (agent_id) WHERE r <= 3 GROUP BY 1")
_add("session_trend", "s", lambda s: coordination.session_trend(s.where("agent_id = 1").select("session_id", "started_at", F.col("tasks_completed").alias("hits"), F.col("tool_calls").alias("total"))).select(F.round("first", 6).alias("first"), F.round("second", 6).alias("second"), "trend"), "SELECT round(a, 6) AS first, round(b, 6) AS second, CASE WHEN b - a > 0.05 THEN 'improving' WHEN a - b > 0.05 THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT coalesce(sum(tasks_completed) FILTER (h = 1)::DOUBLE / sum(tool_calls) FILTER (h = 1), 0) AS a, coalesce(sum(tasks_completed) FILTER (h = 2)::DOUBLE / sum(tool_calls) FILTER (h = 2), 0) AS b FROM (SELECT *, ntile(2) OVER (ORDER BY started_at, session_id) AS h FROM s WHERE agent_id = 1))")
_add("package_work", "tc", lambda tc: coordination.package_work(tc.select(F.concat("tool_name", F.lit("/d"), (F.col("id") % 4).cast("string"), F.lit("/f"), "entity").alias("file"), "entity")), "SELECT tool_name || '/d' || (id % 4) AS dir, count(DISTINCT entity) AS files, count(DISTINCT entity) AS entities FROM tc GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
_add("events_since", "tc", lambda tc: coordination.events_since(tc.select(F.col("id").alias("seq"), F.col("tool_name").alias("type"), F.col("agent_id").cast("string").alias("agent_id")), 100, ["click", "view"], "3"), "SELECT id AS seq, tool_name AS type, agent_id::VARCHAR AS agent_id FROM tc WHERE id > 100 AND tool_name IN ('click', 'view') AND agent_id = 3 ORDER BY 1 LIMIT 100")
_add("latest_state", "tc", lambda tc: coordination.latest_state(tc.select("agent_id", F.col("id").alias("at"), "tool_name"), ["agent_id"]), "SELECT agent_id, max(id) AS at, arg_max(tool_name, id) AS tool_name FROM tc GROUP BY 1")
_add("work_overlaps", "tc", lambda tc: coordination.overlaps(tc.where("tool_name = 'signup'").groupBy("session_id").agg(F.collect_set(F.concat(F.lit("f"), (F.col("id") % 40).cast("string"))).alias("files"), F.collect_set("entity").alias("entities"))), "SELECT a, b, min(level)::INT AS level, arg_min(sh, level) AS shared FROM (SELECT a, b, level, array_to_string(list_sort(list(x))[1:3], ',') AS sh FROM (SELECT DISTINCT p.session_id AS a, q.session_id AS b, p.level, p.x FROM (SELECT session_id, 0 AS level, 'f' || (id % 40) AS x FROM tc WHERE tool_name = 'signup' UNION SELECT session_id, 1, entity FROM tc WHERE tool_name = 'signup') p JOIN (SELECT session_id, 0 AS level, 'f' || (id % 40) AS x FROM tc WHERE tool_name = 'signup' UNION SELECT session_id, 1, entity FROM tc WHERE tool_name = 'signup') q ON p.level = q.level AND p.x = q.x AND p.session_id < q.session_id) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _annotations(tc, rows):
    return tc.where(rows).select(F.col("project_id").alias("node_id"), F.col("tool_name").alias("agent_id"), F.lit("n").alias("note"), F.col("created_at").alias("at"))


_add(
    "annotations_kept", "tc", lambda tc: coordination.new_annotations(_annotations(tc, "id % 3 = 0"), _annotations(tc, "id % 3 <> 0"), 600).groupBy("node_id", "agent_id").agg(F.count("*").alias("n")),
    "SELECT project_id AS node_id, tool_name AS agent_id, count(*) AS n FROM (SELECT project_id, tool_name, id, epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY project_id, tool_name ORDER BY created_at, id % 3 <> 0)) AS gap FROM tc) WHERE id % 3 <> 0 AND (gap IS NULL OR gap > 36000000000) GROUP BY 1, 2",
)
_add("agents_present", "tc", lambda tc: coordination.agents_present(tc.groupBy("agent_id").agg(F.max("created_at").alias("last_seen_at")), F.lit("2024-01-30 23:00:00").cast("timestamp")), "SELECT CASE WHEN m <= 8 THEN 'active' WHEN m <= 15 THEN 'idle' ELSE 'inactive' END AS presence, count(*) AS agents FROM (SELECT (epoch_us(TIMESTAMP '2024-01-30 23:00:00') - epoch_us(max(created_at))) / 6e7 AS m FROM tc GROUP BY agent_id) GROUP BY 1")
_add("outcomes_set", "cd os", lambda cd, os: coordination.with_outcomes(cd.withColumn("outcome", F.when(F.col("id") % 4 == 0, "known")), os.select("session_id", F.col("signal_type").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n")), "SELECT CASE WHEN id % 4 = 0 THEN 'known' ELSE found END AS outcome, count(*) AS n FROM cd LEFT JOIN (SELECT session_id, max(signal_type) AS found FROM os GROUP BY 1) USING (session_id) GROUP BY 1")
_add(
    "rate_limits", "tc", lambda tc: coordination.token_bucket(tc.withColumn("key", F.col("project_id") % 2), "key", "created_at", 1, 2).groupBy("key", "allowed").agg(F.count("*").alias("n")),
    "SELECT key, allowed, count(*) AS n FROM (WITH RECURSIVE o AS (SELECT project_id % 2 AS key, epoch_us(created_at) AS t, row_number() OVER (PARTITION BY project_id % 2 ORDER BY created_at, id) AS r FROM tc), "
    "f AS (SELECT key, r, t, 2.0::DOUBLE AS had FROM o WHERE r = 1 UNION ALL SELECT o.key, o.r, o.t, least(2.0, f.had - (f.had >= 1)::INT + (o.t - f.t) / 6e7) FROM f JOIN o ON o.key = f.key AND o.r = f.r + 1) SELECT key, had >= 1 AS allowed FROM f) GROUP BY 1, 2",
)
