"""Staged call resolution against one-by-one lookups, and refreshing against resolving all."""

import random

from pyspark.sql import functions as F

from grafonda.operators import calls

NODES = "id string, type string, name string, package string, file string"
SITES = "site string, caller_id string, caller_name string, package string, file string, alias string, func string"


def world(seed):
    rng = random.Random(seed)
    packages, types, funcs = ["p", "q", "r", "v2"], ["A", "B", "C", "D"], ["run", "load", "save", "go", "stop"]
    nodes = []
    for k in range(26):
        t = rng.choice([None, *types])
        f = rng.choice(funcs)
        pkg = rng.choice(["p", "q", "r", "s"])
        nodes.append((f"n{k}", "method" if t else "function", f"{t}.{f}" if t else f, pkg, f"{pkg}/{rng.randint(0, 2)}.x"))
    imports = sorted({(f"{p}/{k}.x", a, f"lib/{d}") for p in "pqrs" for k in range(3) for a, d in [(rng.choice(["al", "bl"]), rng.choice(packages)) for _ in range(2)]})
    imports = list({(f, a): (f, a, d) for f, a, d in imports}.values())
    variables = list({(f"{p}/{k}.x", v): (f"{p}/{k}.x", v, rng.choice(types)) for p in "pqrs" for k in range(3) for v in ("x", "self.y") if rng.random() < 0.7}.values())
    parents = [("A", "B"), ("B", "C")] if seed % 2 else [("D", "A")]
    sites = []
    for k in range(90):
        n = rng.choice(nodes)
        sites.append((f"s{k}", n[0], n[2], n[3], n[4], rng.choice([None, "", "self", "super", "al", "bl", "x", "self.y", "y", "zz"]), rng.choice([*funcs, "nope"])))
    return nodes, imports, variables, parents, sites, [("v2", "s")]


def by_hand(nodes, imports, variables, parents, sites, folders):
    by_owner = {}
    for i, _, name, _, _ in sorted(nodes):
        if "." in name:
            by_owner.setdefault(tuple(name.rsplit(".", 1)), i)
    up, folder, var = dict(parents), dict(folders), {(f, v): t for f, v, t in variables}

    def typed(t, func, own=True):
        seen = []
        while t and t not in seen:
            seen.append(t)
            if (own or len(seen) > 1) and (t, func) in by_owner:
                return by_owner[t, func]
            t = up.get(t)
        return None

    def within(package, func):
        hits = sorted((name, i) for i, _, name, p, _ in nodes if p == package and name.rsplit(".", 1)[-1] == func)
        return hits[0][1] if hits else None

    def at(path, func):
        short = path.rsplit("/", 1)[-1]
        return within(short, func) or (within(folder[short], func) if short in folder else None)

    out = set()
    for site, caller, name, package, file, written, func in sites:
        written = written or ""
        alias = written.removeprefix("self.").removeprefix("this.")
        own = [d for f, a, d in imports if f == file]
        steps = [
            (1, lambda: typed(name.rsplit(".", 1)[0], func, alias != "super") if alias in ("self", "this", "super") and "." in name else None),
            (2, lambda: next((x for f, a, d in imports if f == file and a == alias and alias and (x := at(d, func))), None)),
            (3, lambda: next((x for v in (alias, written) if alias and (file, v) in var and (x := typed(var[file, v], func))), None)),
            (4, lambda: within(package, func)),
            (5, lambda: None if not alias and func in calls.TOO_COMMON else next((x for d in sorted(set(own)) if (x := at(d, func))), None)),
        ]
        for stage, step in steps:
            if target := step():
                out.add((site, caller, target, stage))
                break
    return out


def frames(spark, nodes, imports, variables, parents, sites, folders):
    make = spark.createDataFrame
    return make(nodes, NODES), make(imports, "file string, alias string, path string"), make(variables, "file string, var string, type string"), make(parents, "type string, parent string"), make(sites, SITES), make(folders, "folder string, package string")


def test_stages(spark):
    w = world(3)
    nodes, imports, variables, parents, sites, folders = frames(spark, *w)
    got = calls.resolved(sites, nodes, imports, variables, parents, folders)
    rows = {tuple(r) for r in got.collect()}
    assert rows == by_hand(*w) and {r[3] for r in rows} == {1, 2, 3, 4, 5}
    edges = calls.edges_of(got)
    assert edges.count() == len({r[1:3] for r in rows}) and calls.edges_of(got, edges).count() == 0


def test_one_changed_file_refreshes_what_depends_on_it(spark):
    w = world(3)
    nodes, imports, variables, parents, sites, folders = frames(spark, *w)
    old = spark.createDataFrame(sorted(by_hand(*w)), "site string, from_id string, to_id string, stage int")
    file = "q/1.x"
    changed = [n for n in w[0] if n[4] != file] + [("new", "method", "C.go", "q", file)]
    there = {n[0] for n in changed}
    kept = [s for s in w[4] if s[1] in there] + [("s900", "new", "C.go", "q", file, "x", "run")]
    w2 = (changed, *w[1:4], kept, w[5])
    after, _, _, _, sites2, _ = frames(spark, *w2)
    again = calls.touched(sites2, nodes, after, spark.createDataFrame([(file,)], "file string"), parents, parents)
    assert 0 < again.count() < sites2.count()
    got = calls.refreshed(old, again, sites2, after, imports, variables, parents, folders)
    assert {tuple(r) for r in got.collect()} == by_hand(*w2)
    more = spark.createDataFrame([*w[3], ("C", "D")], "type string, parent string")
    wide = calls.touched(sites2, nodes, after, spark.createDataFrame([(file,)], "file string"), parents, more)
    assert wide.join(sites2.where("coalesce(alias, '') <> ''").select("site"), "site", "left_semi").count() == sites2.where(F.coalesce("alias", F.lit("")) != "").count()
