"""Architecture rules over edges: forbidden edges by the types, packages and files of both ends and the target's name, what-if checks and a
violation log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import cut

SCHEMA = "rule_id string, severity string, from_type string, to_type string, edge_type string, from_package string, to_package string"
#: Rules that are broadcast at most.
MANY = 10_000
#: Nodes of one end that may be broadcast.
FEW_NODES = 1 << 18
_FIELDS = ("from_type", "to_type", "edge_type", "from_package", "to_package")
#: Fields that a table of rules may have besides: globs of both files, and a part of the target's name.
_MORE = ("from_file", "to_file", "to_name")


def glob_pattern(glob: Column) -> Column:
    """A glob (* and ? stop at "/", classes as in expressions), tried on every suffix of a path, as an expression for rlike."""
    plain = F.regexp_replace(glob, r"([.+(){}|^$\\])", r"\\$1")
    return F.concat(F.lit("(^|/)"), F.regexp_replace(F.regexp_replace(plain, r"\*+", "[^/]*"), r"\?", "[^/]"), F.lit("$"))


def violations(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, severity, from_id, to_id, type. An empty field of a rule allows anything; a rule of empty fields never fires.

    Rules are configuration. Up to MANY of them are broadcast to the nodes: each node gets the numbers of the rules that it fits at either end, and
    edges meet these numbers in two equi joins, the end that fewer nodes fit first. Beyond that, edges meet their ends' columns, and rules are
    joined; those that name an edge type meet edges of that type only."""
    filled = rules.withColumns({c: F.coalesce(F.col(c), F.lit("")) if c in rules.columns else F.lit("") for c in (*_FIELDS, *_MORE)})
    live = filled.where(" or ".join(f"{c} <> ''" for c in (*_FIELDS, *_MORE))).withColumns({f"{c}_glob": glob_pattern(F.col(c)) for c in ("from_file", "to_file")})
    ends = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("type").alias(f"{side}_t"), F.lower("package").alias(f"{side}_p"), F.translate("file", "\\", "/").alias(f"{side}_f"), F.col("name").alias(f"{side}_n"))
    if live.limit(MANY + 1).count() <= MANY:
        return _by_ends(edges, ends, cut(live.withColumn("k", F.monotonically_increasing_id()), "rules"))
    full = edges.join(ends("from"), "from_id").join(ends("to"), "to_id")
    fits = (
        F.expr("from_type = '' or from_type = from_t") & F.expr("to_type = '' or to_type = to_t") & F.expr("edge_type = '' or edge_type = type")
        & F.expr("from_package = '' or contains(from_p, lower(from_package))") & F.expr("to_package = '' or contains(to_p, lower(to_package))")
        & F.expr("from_file = '' or rlike(from_f, from_file_glob)") & F.expr("to_file = '' or rlike(to_f, to_file_glob)") & F.expr("to_name = '' or contains(to_n, to_name)")
    )
    typed = full.join(live.where("edge_type <> ''"), (F.col("type") == F.col("edge_type")) & fits)
    return typed.unionByName(full.join(live.where("edge_type = ''"), fits)).select("rule_id", "severity", "from_id", "to_id", "type")


def _by_ends(edges: DataFrame, ends: Callable[[str], DataFrame], live: DataFrame) -> DataFrame:
    """violations() for few rules, numbered k."""
    kinds = {r["edge_type"] for r in live.select("edge_type").distinct().collect()}  # at most MANY
    held = F.broadcast(live.agg(F.collect_list(F.struct(*live.columns)).alias("rules")))
    some = lambda side, and_: F.expr(f"transform(filter(rules, r -> (r.{side}_type = '' or r.{side}_type = {side}_t) and (r.{side}_package = '' or contains({side}_p, lower(r.{side}_package))) and (r.{side}_file = '' or rlike({side}_f, r.{side}_file_glob)){and_}), r -> r.k)")
    sides = []
    for side, and_ in (("from", ""), ("to", " and (r.to_name = '' or contains(to_n, r.to_name))")):
        fit = ends(side).crossJoin(held).select(f"{side}_id", some(side, and_).alias(f"{side}_k")).where(F.size(f"{side}_k") > 0)
        sides.append((cut(fit, "ends"), f"{side}_id"))
    met = edges if "" in kinds else edges.where(F.col("type").isin(*kinds))
    for n, fit, key in sorted(((fit.count(), fit, key) for fit, key in sides), key=lambda s: s[0]):
        # ids compress so well that a file's size says little of a table's
        met = met.join(fit if n <= FEW_NODES else fit.hint("merge"), key)
    each = met.select("from_id", "to_id", "type", F.explode(F.array_intersect("from_k", "to_k")).alias("k"))
    return each.join(F.broadcast(live.select("k", "rule_id", "severity", "edge_type")), "k").where("edge_type = '' or edge_type = type").select("rule_id", "severity", "from_id", "to_id", "type")


def what_if(nodes: DataFrame, edges: DataFrame, callers: DataFrame, callees: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations that planned calls from callers(id) to callees(id), both few, would add."""
    planned = callers.select(F.col("id").alias("from_id")).crossJoin(F.broadcast(callees.select(F.col("id").alias("to_id")))).withColumn("type", F.lit("CALLS"))
    new = planned.join(edges, ["from_id", "to_id", "type"], "left_anti")
    return violations(nodes, new, rules)


def log_of(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_id").agg(F.count("*").alias("found"), F.countDistinct("from_id").alias("sources"))


def merged_log(log: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """The log with found violations: first_seen stays, last_seen moves, occurrences grow."""
    new = found.select(F.sha2(F.concat_ws("|", "rule_id", "from_id", "to_id", "type"), 256).alias("id"), "rule_id", "severity", F.lit(now).cast("timestamp").alias("first_seen"), F.lit(now).cast("timestamp").alias("last_seen"), F.lit(1).cast("long").alias("occurrences"))
    return log.unionByName(new).groupBy("id").agg(F.any_value("rule_id").alias("rule_id"), F.any_value("severity").alias("severity"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("occurrences").alias("occurrences"))


def suggestion(edge_type: Column) -> Column:
    """A line of advice for a violation of this type of edge."""
    return F.when(edge_type == "CALLS", "put an interface between caller and callee").when(edge_type == "IMPORTS", "move what both need to a package of its own").when(edge_type == "DEPENDS_ON", "turn the dependency around").otherwise("check the rule")


def path_violations(nodes: DataFrame, edges: DataFrame, found: list[tuple[str, str, tuple[str, ...], Column, Column]]) -> DataFrame:
    """rule_id, severity, start_id, end_id for rules (id, severity, edge types in order, condition of the start, of the end): each pair of ends
    once, with ends deduplicated at every step."""
    from .graph import path_pattern

    out = None
    for rule_id, severity, kinds, start, end in found:
        own = path_pattern(nodes, edges, list(kinds), start, end).select(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), "start_id", "end_id")
        out = own if out is None else out.unionByName(own)
    return out


def upserted(rules: DataFrame, new: DataFrame) -> DataFrame:
    """rules with new ones, which replace those of their id."""
    return rules.join(new.select("rule_id"), "rule_id", "left_anti").select(*rules.columns).unionByName(new.select(*rules.columns))


def verification(changes: DataFrame, edges: DataFrame, many: int = 10) -> DataFrame:
    """id, callers, high_fan_in of changes(id): what has to be looked at after signatures changed."""
    callers = edges.where("type = 'CALLS'").join(changes.select(F.col("id").alias("to_id")), "to_id", "left_semi").groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("callers"))
    return changes.select("id").join(callers, "id", "left").select("id", F.coalesce("callers", F.lit(0)).alias("callers"), (F.coalesce("callers", F.lit(0)) >= many).alias("high_fan_in"))


def verified_claims(claims: DataFrame, nodes: DataFrame, edges: DataFrame, is_test: Column) -> DataFrame:
    """id, claim, holds of claims(id, claim): what a text says of a node's callers, tests or callees, held against the graph; null where the
    claim says nothing that the graph knows."""
    calls = edges.where("type = 'CALLS'")
    tests = nodes.where(is_test).select(F.col("id").alias("from_id"), F.lit(1).alias("test"))
    into = calls.join(tests, "from_id", "left").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("fan_in"), F.count("test").alias("tests"))
    out_of = calls.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("fan_out"))
    both = claims.join(into, "id", "left").join(out_of, "id", "left").na.fill(0, ["fan_in", "tests", "fan_out"])
    says = lambda *words: F.rlike(F.lower("claim"), F.lit("|".join(words)))
    holds = (
        F.when(says("widely used", "many callers", "hotspot"), F.col("fan_in") > 5).when(says("untested", "no tests"), F.col("tests") == 0).when(says("well tested", "is tested"), F.col("tests") > 0)
        .when(says("unused", "dead code"), F.col("fan_in") == 0).when(says("leaf"), F.col("fan_out") == 0)
    )
    return both.select("id", "claim", holds.alias("holds"))


def review_summary(affected: DataFrame, nodes: DataFrame, is_test: Column) -> DataFrame:
    """One row: how many nodes are affected directly and further on, in how many files, and how many of them are tests."""
    named = affected.join(nodes.select("id", "file"), "id")
    return named.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"), F.countDistinct("file").alias("files"), F.count_if(is_test).alias("tests"))
