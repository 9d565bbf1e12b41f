"""Edges derived by joins between code, documents, infrastructure and knowledge: typed and inherited calls, links from prose, files and
code blocks, matching names across domains, references and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, words
from .graph import chosen
from .work import cut

# Names that say nothing across domains, how strongly a domain owns a name, and pairs of types that belong together.
GENERIC = ("main", "init", "test", "run", "new", "get", "set", "config", "data", "name", "type", "value", "index", "default", "error", "info", "list", "file", "user", "item")
DOMAIN_ORDER = {"code": 0, "api": 1, "infra": 2, "docs": 3}
ALLIED = (("struct", "resource"), ("interface", "service"), ("struct", "table"), ("function", "route"), ("struct", "message"), ("interface", "rpc"))
#: Nodes of one name and domain that meet others in one block, about.
BLOCK = 2048
#: Tasks that the blocks' meetings are dealt to at most.
MOST_TASKS = 4096


def ancestors(parents: DataFrame, depth: int = 10) -> DataFrame:
    """type, ancestor, distance of parents(type, parent), up to depth steps; a type is its own ancestor at 0."""
    level = parents.select("type", F.col("type").alias("ancestor")).distinct().withColumn("distance", F.lit(0))
    seen = level
    for hop in range(1, depth + 1):
        up = level.join(parents.select(F.col("type").alias("ancestor"), "parent"), "ancestor").select("type", F.col("parent").alias("ancestor")).distinct()
        level = cut(up.join(seen.select("type", "ancestor"), ["type", "ancestor"], "left_anti").withColumn("distance", F.lit(hop)), "ancestors")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def typed_methods(sites: DataFrame, types: DataFrame, methods: DataFrame, parents: DataFrame) -> DataFrame:
    """site, to_id: the method that a call on a variable means: of the variable's type, types(file, var, type), or else of its nearest
    ancestor that has it, methods(id, owner, method)."""
    asked = sites.join(types, ["file", "var"]).select("site", "type", "func")
    line = ancestors(parents)
    near = asked.join(line, "type", "left").withColumns({"owner": F.coalesce("ancestor", "type"), "distance": F.coalesce("distance", F.lit(0))})
    hits = near.join(methods.select(F.col("id").alias("to_id"), "owner", F.col("method").alias("func")), ["owner", "func"])
    return hits.groupBy("site").agg(F.min_by("to_id", F.struct("distance", "to_id")).alias("to_id"))


def package_targets(sites: DataFrame, nodes: DataFrame, instantiated: DataFrame | None = None) -> DataFrame:
    """site, to_id: what a plain name means within a package: the function of that name, or methods of it (Type.name). With
    instantiated(package, type) all methods whose type is ever made, else the first by name."""
    named = nodes.select(F.col("id").alias("to_id"), "package", "name", F.substring_index("name", ".", -1).alias("func"), F.substring_index("name", ".", 1).alias("type"))
    asked = sites.select("site", "package", "func")
    if instantiated is not None:
        hits = asked.join(named, ["package", "func"])
        made = instantiated.select("package", "type", F.lit(True).alias("made")).distinct()
        hits = hits.join(made, ["package", "type"], "left")
        live = hits.where("name = func or made").select("site", "to_id")
        return live.distinct()
    # a package may have a name many times: its first is found before sites meet it
    first = named.groupBy("package", "func").agg(F.min(F.struct("name", "to_id")).alias("first"))
    return asked.join(first, ["package", "func"]).groupBy("site").agg(F.min("first").alias("first")).select("site", "first.to_id")


def file_links(references: DataFrame, files: DataFrame) -> DataFrame:
    """section, file: paths in prose, references(section, path), matched to files(file) by a suffix at a slash; a bare name that no suffix
    matches goes to the file of that base name, if there is just one."""
    suffixes = files.select("file", F.explode(F.expr("transform(sequence(1, size(split(file, '/'))), k -> substring_index(file, '/', -k))")).alias("path"))
    clean = references.select("section", F.regexp_replace("path", r"^\./", "").alias("path"))
    by_suffix = clean.join(suffixes, "path").select("section", "path", "file")
    base = files.select("file", F.substring_index("file", "/", -1).alias("base")).groupBy("base").agg(F.min("file").alias("file"), F.count("*").alias("n")).where("n = 1")
    rest = clean.join(by_suffix.select("section", "path"), ["section", "path"], "left_anti").withColumn("base", F.substring_index("path", "/", -1))
    return by_suffix.select("section", "file").unionByName(rest.join(base, "base").select("section", "file")).distinct()


def block_links(sections: DataFrame, nodes: DataFrame, least: int = 4, most: int = 3) -> DataFrame:
    """section, to_id: identifiers in a section's fenced code blocks that name a node; short names and those of more than `most` nodes say
    nothing."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))
    found = sections.select("section", F.explode(F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"[A-Za-z_][A-Za-z0-9_]{3,}"), F.lit(0)))))).alias("name"))
    clear = nodes.where(F.length("name") >= least).groupBy("name").agg(F.collect_set("id").alias("ids")).where(F.size("ids") <= most)
    return found.join(clear, "name").select("section", F.explode("ids").alias("to_id")).distinct()


def cross_domain_mentions(nodes: DataFrame, least: float = 0.6) -> DataFrame:
    """from_id, to_id, confidence: nodes of different domains with one normalised name. Files, packages, nodes without a domain, short and
    generic names are left out; an exact name, one directory and allied types add to the confidence; the domain that owns names points.

    Nodes of a name meet by pairs of domains, in a grid of blocks of about BLOCK nodes of either side, so no task holds all pairs of a name."""
    key = scalars.normalized_name(F.col("name"))
    held = nodes.where(F.col("domain").isin(*DOMAIN_ORDER) & ~F.col("type").isin("file", "package")).select("id", "name", "type", "domain", F.regexp_replace("file", "/[^/]*$", "").alias("dir"), key.alias("key"))
    held = held.where((F.length("key") >= 4) & ~F.col("key").isin(*GENERIC))
    place = chosen(F.col("domain"), DOMAIN_ORDER, 9)
    places = sorted(set(DOMAIN_ORDER.values()))
    held = held.withColumn("place", place)
    sizes = cut(held.groupBy("key", "place").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "names")
    held = held.join(sizes, ["key", "place"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    size = lambda end: sizes.select("key", F.col("place").alias(end), F.col("blocks").alias("others"))
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("id", "name", "type", "domain", "dir", "place", "block")]
    beside = lambda own: F.filter(F.array(*map(F.lit, places)), own)
    a = held.select("key", *side("a")).withColumn("b_place", F.explode(beside(lambda p: p > F.col("a_place")))).join(size("b_place"), ["key", "b_place"])
    b = held.select("key", *side("b")).withColumn("a_place", F.explode(beside(lambda p: p < F.col("b_place")))).join(size("a_place"), ["key", "a_place"])
    a = a.withColumn("b_block", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).drop("others")
    b = b.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).drop("others")
    # rows are few bytes beside their pairs: cells are dealt to tasks by their number, which bytes would not tell
    summed = sizes.groupBy("key").agg(F.sum(F.col("blocks").cast("double")).alias("s"), F.sum(F.col("blocks").cast("double") * F.col("blocks")).alias("q"))
    cells = summed.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0.0))).first()[0]
    cell, tasks = ["key", "a_place", "b_place", "a_block", "b_block"], int(min(max(cells, 1), MOST_TASKS))
    pairs = a.repartition(tasks, *cell).hint("shuffle_merge").join(b.repartition(tasks, *cell), cell)
    allied = F.lit(False)
    for x, y in ALLIED:
        allied = allied | ((F.col("a_type") == x) & (F.col("b_type") == y))
    sure = 0.65 + F.when(F.col("a_name") == F.col("b_name"), 0.1).otherwise(0.0) + F.when(F.col("a_dir") == F.col("b_dir"), 0.1).otherwise(0.0) + F.when(allied, 0.1).otherwise(0.0)
    return pairs.select(F.col("a_id").alias("from_id"), F.col("b_id").alias("to_id"), F.round(F.least(sure, F.lit(1.0)), 2).alias("confidence")).where(F.col("confidence") >= least)


def reference_edges(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_id, to_id: infrastructure nodes that refer to others by name, references(from_id, ref); self references say nothing."""
    return references.join(nodes.select(F.col("id").alias("to_id"), F.col("name").alias("ref")), "ref").where("from_id <> to_id").select("from_id", "to_id").distinct()


def aliased_paths(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """file, path, resolved: import paths rewritten by aliases(pattern, target), where * stands for any text; the longest pattern that fits
    counts, and paths that none fits stay."""
    prefix, target = F.substring_index("pattern", "*", 1), F.substring_index("target", "*", 1)
    starred = F.contains(F.col("pattern"), F.lit("*"))
    # aliases of a configuration file are few; they meet paths by equal first segments
    first = lambda c: F.split(c, "/")[0]
    few = F.broadcast(aliases.select("pattern", prefix.alias("prefix"), target.alias("to"), starred.alias("starred"), first("pattern").alias("head")))
    hits = imports.withColumn("head", first("path")).join(few, "head").where(F.expr("(starred and startswith(path, prefix)) or (not starred and path = pattern)"))
    new = F.when(F.col("starred"), F.concat("to", F.expr("substring(path, length(prefix) + 1)"))).otherwise(F.col("to"))
    best = hits.withColumn("new", new).groupBy("file", "path").agg(F.max_by("new", F.struct(F.length("pattern"), "pattern")).alias("new"))
    return imports.join(best, ["file", "path"], "left").select("file", "path", F.coalesce("new", "path").alias("resolved"))


def type_references(fields: DataFrame, messages: DataFrame) -> DataFrame:
    """from_id, to_id: message fields(from_id, type) whose type names a message(id, name), by its last part."""
    return fields.select("from_id", F.substring_index("type", ".", -1).alias("name")).join(messages.select(F.col("id").alias("to_id"), "name"), "name").where("from_id <> to_id").select("from_id", "to_id").distinct()


def task_links(tasks: DataFrame, nodes: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """task_id, node_id, rank: nodes whose name is a word of a task's text, in the order of the words, up to `most` a task."""
    word = F.posexplode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z0-9_]+"), lambda w: F.length(w) >= least)))
    asked = tasks.select("task_id", word.alias("place", "key"))
    hits = asked.join(nodes.select(F.col("id").alias("node_id"), F.lower("name").alias("key")), "key")
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy("place", "node_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most).select("task_id", "node_id", "rank")


def concepts(sections: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concept nodes (id, name, confidence) for candidates in prose that no node is named after, and their edges to sections."""
    found = sections.select("section", F.explode(words.candidates(F.col("text"))).alias("c")).select("section", F.lower(F.trim("c.name")).alias("name"), "c.confidence")
    known = nodes.select(F.lower(F.trim("name")).alias("name")).distinct()
    new = found.join(known, "name", "left_anti")
    concept = new.groupBy("name").agg(F.max("confidence").alias("confidence")).select(F.concat(F.lit("concept::"), "name").alias("id"), "name", "confidence")
    return concept, new.select(F.col("section").alias("from_id"), F.concat(F.lit("concept::"), "name").alias("to_id")).distinct()


# How alike a section and a piece of code must be, by how coarse the piece is.
LEVELS = {"entity": 0.60, "file": 0.55, "module": 0.50}


def embedded_doc_links(matches: DataFrame, most: int = 3) -> DataFrame:
    """section, to_id, level, score of matches(section, to_id, level, score): a section's finest level with a match that is alike enough, at
    most `most` links."""
    good = matches.where(F.col("score") >= chosen(F.col("level"), LEVELS, 1.0))
    order = chosen(F.col("level"), {k: n for n, k in enumerate(LEVELS)}, 9)
    finest = good.withColumn("order", order).withColumn("best", F.min("order").over(Window.partitionBy("section"))).where("order = best")
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), "to_id"))
    return finest.withColumn("rank", rank).where(F.col("rank") <= most).select("section", "to_id", "level", "score")


def embedded_relations(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(left_id, right_id, score) that no edge links yet, in either direction, each pair once."""
    a, b = F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
    linked = edges.select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()
    once = pairs.where("left_id <> right_id").select(a.alias("a"), b.alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))
    return once.join(linked, ["a", "b"], "left_anti")


def entity_finder(query: str, nodes: DataFrame, edges: DataFrame, is_test: Column, most: int = 50) -> DataFrame:
    """id, name, type, file, tier, callers, callees: nodes by name, else by a part of the name, else methods of a type so named; types
    before functions before others, tests last, short paths first."""
    q, short = query.lower(), F.lower(F.substring_index("name", ".", -1))
    stages = ((F.lower("name") == q) | (short == q), F.contains(F.lower("name"), F.lit(q)), F.startswith(F.lower("name"), F.lit(q.rsplit(".", 1)[0] + ".")))
    staged = nodes.withColumn("stage", F.when(stages[0], 0).when(stages[1], 1).when(stages[2], 2)).where("stage is not null")
    first = staged.agg(F.min("stage")).first()[0]
    tier = F.when(F.col("type").isin("struct", "interface"), 0).when(F.col("type").isin("function", "method"), 1).otherwise(2)
    found = staged.where(F.col("stage") == F.lit(first)).withColumns({"tier": tier, "test": is_test}).orderBy("tier", "test", F.length("file"), "file", "id").limit(most)
    calls = edges.where("type = 'CALLS'")
    ids = F.broadcast(found.select("id"))  # at most `most` rows
    count = lambda end, name: calls.join(ids, F.col(end) == F.col("id"), "left_semi").groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))
    both = found.join(count("to_id", "callers"), "id", "left").join(count("from_id", "callees"), "id", "left")
    return both.select("id", "name", "type", "file", "tier", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("callers", "callees")])
