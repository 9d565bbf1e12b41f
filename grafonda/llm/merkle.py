"""Merkle manifest of a dataset: a tree of digests for each branch (language), one tree over the branches' subroots, and every row's proof.

Rows become leaves: sha256 of their fields, in Spark's own functions. Leaves take places within their branch by a range sort and the
counts of its parts. A tree is built in rounds of LEVELS levels: an aligned block of FAN**LEVELS nodes is one matrix of 64-byte hex
digests in a task; a level is the matrix reshaped to FAN digests a row, each row hashed. The blocks' roots are the next round's nodes, so
n rows take log(n) / log(4096) rounds, each spread over all blocks. Proofs go the other way: a block gets its siblings above
from the round above, once for all its rows, and finds the siblings within by index arithmetic on its matrices.

Nulls: a null field has its own spelling in a leaf; a null branch is the first branch; a null key comes first in its branch and is not
tampered with. Ties: rows with equal keys stand in order of their leaves, equal ones in the order they are read. Repeated rows:
each is a leaf. Empty texts and very long ones are hashed whole. Empty table: an empty result, no root. Only the columns named are
read, so others never clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import work_table

FAN = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


@dataclass
class Tree:
    """rounds[0]: the leaves (branch, rank, n, digest and what they carry); rounds[k]: the roots of the blocks of rounds[k-1]; the last
    one holds one node for each branch."""

    rounds: list[DataFrame]


def field(value: Column) -> Column:
    """'-' for null, else the number of UTF-8 bytes, ':' and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def height(n: int, fan: int = FAN) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n = -(-n // fan)
        levels += 1
    return levels


def hashed_rows(nodes: np.ndarray, fan: int = FAN) -> np.ndarray:
    """The level above: every `fan` digests in a row become one, the last row may be shorter."""
    whole = len(nodes) // fan * fan
    out = [hashlib.sha256(row).hexdigest() for row in nodes[:whole].reshape(-1, fan * _HEX)]
    if whole < len(nodes):
        out.append(hashlib.sha256(np.ascontiguousarray(nodes[whole:])).hexdigest())
    return np.frombuffer("".join(out).encode(), np.uint8).reshape(-1, _HEX)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The digests of a column as rows of 64 bytes."""
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, _HEX)


def stack(nodes: np.ndarray, levels: int, fan: int = FAN) -> list[np.ndarray]:
    """The nodes and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append(hashed_rows(out[-1], fan))
    return out


def siblings(levels: list[np.ndarray], fan: int = FAN) -> list[list[tuple[bytes, bytes]]]:
    """For each level but the top one, the digests left and right of each node in its run."""
    out = []
    for nodes in levels[:-1]:
        data, n = nodes.tobytes(), len(nodes)
        out.append([(data[_HEX * (k - k % fan) : _HEX * k], data[_HEX * (k + 1) : _HEX * min(k - k % fan + fan, n)]) for k in range(n)])
    return out


def ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes, which have a branch, with rank (within the branch, from 0) and n (nodes of the branch), by a range sort. Equal nodes are
    told apart by the place they are read at, so they may go to many tasks."""
    keys = ["branch", *order, "tie"]
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    placed = work_table(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    runs = placed.groupBy("part", "branch").agg(F.min("at").alias("first"), F.count("*").alias("size"))  # at most the parts and the branches together
    of_branch = Window.partitionBy("branch")
    runs = runs.withColumns({"base": F.sum("size").over(of_branch.orderBy("part")) - F.col("size") - F.col("first"), "n": F.sum("size").over(of_branch)})
    return placed.join(runs.select("part", "branch", "base", "n"), ["part", "branch"]).withColumn("rank", F.col("base") + F.col("at")).drop("part", "at", "base")


def _block(rank: str = "rank", fan: int = FAN, levels: int = LEVELS) -> Column:
    return F.floor(F.col(rank) / fan**levels).cast("long")


def grow(leaves: DataFrame, name: str, fan: int = FAN, levels: int = LEVELS) -> Tree:
    """The tree of ranked leaves."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    rounds = [leaves]

    def root_after(done: int):
        def root(table: pa.Table) -> pa.Table:
            table = table.sort_by("rank")
            n = table.column("n")[0].as_py()
            top = stack(matrix(table.column("digest")), max(0, min(levels, height(n, fan) - done)), fan)[-1]
            return pa.table({"branch": table.column("branch").slice(0, 1), "rank": table.column("block").slice(0, 1), "n": table.column("n").slice(0, 1), "digest": pa.array([top.tobytes().decode()])})

        return root

    for k in range(max(1, -(-height(most, fan) // levels))):
        nodes = rounds[-1].select("branch", "rank", "n", "digest").withColumn("block", _block("rank", fan, levels))
        rounds.append(work_table(nodes.groupBy("branch", "block").applyInArrow(root_after(k * levels), "branch string, rank long, n long, digest string"), name))
    return Tree(rounds)


def _descended(tree: Tree, k: int, above: DataFrame, carried: list[str], make, schema: str, fan: int, levels: int) -> DataFrame:
    """make(table, siblings within its block, its row of `above`) for each block of round k. above: branch, rank, path, subroot, root."""

    def block(table: pa.Table, over: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        n = table.column("n")[0].as_py()
        return make(table, siblings(stack(matrix(table.column("digest")), max(0, min(levels, height(n, fan) - k * levels)), fan), fan), over.to_pylist()[0])

    nodes = tree.rounds[k].select("branch", "rank", "n", "digest", *carried).withColumn("block", _block("rank", fan, levels))
    return nodes.groupBy("branch", "block").cogroup(above.withColumnRenamed("rank", "block").groupBy("branch", "block")).applyInArrow(block, schema)


_PATH = "branch string, rank long, path array<struct<left: binary, right: binary>>, subroot string, root string"


def _path_of(inside: list[list[tuple[bytes, bytes]]], row: int, fan: int) -> list[tuple[bytes, bytes]]:
    return [pairs[row // fan**k] for k, pairs in enumerate(inside)]


def paths(tree: Tree, above: DataFrame, name: str, down_to: int = 1, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """branch, rank, path, subroot, root of the nodes of round down_to. above: the same of the tree's last round."""

    def make(table, inside, over):
        rest = [(x["left"], x["right"]) for x in over["path"]]
        found = [[{"left": a, "right": b} for a, b in [*_path_of(inside, i, fan), *rest]] for i in range(table.num_rows)]
        kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
        same = [pa.array([over[c]] * table.num_rows, pa.string()) for c in ("subroot", "root")]
        return pa.table([table.column("branch"), table.column("rank"), pa.array(found, kind), *same], ["branch", "rank", "path", "subroot", "root"])

    for k in range(len(tree.rounds) - 2, down_to - 1, -1):
        above = work_table(_descended(tree, k, above, [], make, _PATH, fan, levels), name)
    return above


def manifest(rows: DataFrame, key: str = "doc_id", branch: str = "lang", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, fan: int = FAN, levels: int = LEVELS) -> tuple[Tree, DataFrame]:
    """(the tree of rows, what is above its subroots). changed: columns in place of those of the same names; leaves of rows so changed are
    carried as `altered`, null where nothing is given."""
    columns = {c: F.col(c) for c in fields}
    branched = F.when(F.col(branch).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(branch).cast("string")))  # '-' sorts before '='
    altered = leaf(*(columns | changed).values()) if changed else F.lit(None).cast("string")
    leaves = work_table(rows.select(F.col(key).alias("key"), branched.alias("branch"), leaf(*columns.values()).alias("digest"), altered.alias("altered")), "leaves")
    tree = grow(ranked(leaves, ["key", "digest"], "ranked_leaves"), "blocks", fan, levels)
    subroots = tree.rounds[-1].select(F.lit("").alias("branch"), F.col("branch").alias("name"), "digest")
    top = grow(ranked(subroots, ["name"], "subroots"), "top", fan, levels)
    root = top.rounds[-1].select("branch", "rank", F.array().cast("array<struct<left: binary, right: binary>>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    over = paths(top, root, "top_paths", 0, fan, levels).select("rank", "path", "root")
    names = top.rounds[0].select("rank", "name", F.col("digest").alias("subroot"))
    return tree, names.join(over, "rank").select(F.col("name").alias("branch"), F.lit(0).cast("long").alias("rank"), "path", "subroot", "root")


def prove(tree: Tree, above: DataFrame, key_type: str, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every row: the root worked out anew from the altered leaf (or the
    leaf itself) and the siblings along its path, and whether it is the root."""

    def make(table, inside, over):
        rest = [(x["left"], x["right"]) for x in over["path"]]
        tail = b"".join(a + b for a, b in rest)
        proofs, folded = [], []
        for i, (own, other) in enumerate(zip(table.column("digest").to_pylist(), table.column("altered").to_pylist(), strict=True)):
            path = _path_of(inside, i, fan)
            proofs.append(hashlib.sha256(b"".join(a + b for a, b in path) + tail).hexdigest())
            node = (other or own).encode()
            for a, b in (*path, *rest):
                node = hashlib.sha256(a + node + b).hexdigest().encode()
            folded.append(node.decode())
        n, root = table.num_rows, over["root"]
        return pa.table([table.column("key"), table.column("digest"), pa.array([over["subroot"]] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([x == root for x in folded])], ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = f"key {key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _descended(tree, 0, paths(tree, above, "block_paths", 1, fan, levels), ["key", "altered"], make, schema, fan, levels)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    tree, above = manifest(docs, changed={"text": tampered})
    return prove(tree, above, docs.schema["doc_id"].dataType.simpleString()).withColumnRenamed("key", "doc_id")


#: crc32 by its definition, bit by bit, over the bytes of the digits. Trees grow level by level in recursive queries.
ORACLE_SQL = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, text, coalesce('=' || lang, '-') AS branch,
    list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda s, b: list_reduce([xor(s, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc_inverted,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents),
leaves AS (
  SELECT row_id, doc_id, branch, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc_inverted, 4294967295) % 3 = 0
      THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered
  FROM docs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY branch ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (
  SELECT 0 AS level, branch, pos, leaf AS h, count(*) OVER (PARTITION BY branch) AS n FROM placed
  UNION ALL
  SELECT level + 1, branch, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1
  GROUP BY level, branch, pos // 8, n),
subroots AS (
  SELECT branch, h AS subroot, level AS levels, row_number() OVER (ORDER BY branch) - 1 AS place FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place AS pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
root AS (SELECT h AS root, level AS top_levels FROM tops WHERE n = 1),
steps AS (
  SELECT p.row_id, x.level AS step, coalesce(string_agg(m.h, '' ORDER BY m.pos) FILTER (m.pos < x.pos), '') AS l,
    coalesce(string_agg(m.h, '' ORDER BY m.pos) FILTER (m.pos > x.pos), '') AS r
  FROM placed p JOIN nodes x ON x.branch = p.branch AND x.n > 1 AND x.pos = p.pos // (8 ** x.level)::BIGINT
  JOIN nodes m ON m.branch = x.branch AND m.level = x.level AND m.pos // 8 = x.pos // 8
  GROUP BY p.row_id, x.level
  UNION ALL
  SELECT p.row_id, s.levels + x.level, coalesce(string_agg(m.h, '' ORDER BY m.pos) FILTER (m.pos < x.pos), ''),
    coalesce(string_agg(m.h, '' ORDER BY m.pos) FILTER (m.pos > x.pos), '')
  FROM placed p JOIN subroots s USING (branch) JOIN tops x ON x.n > 1 AND x.pos = s.place // (8 ** x.level)::BIGINT
  JOIN tops m ON m.level = x.level AND m.pos // 8 = x.pos // 8
  GROUP BY p.row_id, s.levels, x.level),
folds AS (
  SELECT row_id, 0::BIGINT AS step, coalesce(altered, leaf) AS h FROM placed
  UNION ALL
  SELECT row_id, f.step + 1, sha256(l || h || r) FROM folds f JOIN steps s USING (row_id) WHERE s.step = f.step),
proofs AS (SELECT row_id, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY row_id)
SELECT p.doc_id, p.leaf, s.subroot, root.root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM placed p JOIN subroots s USING (branch) CROSS JOIN root
JOIN folds f ON f.row_id = p.row_id AND f.step = s.levels + root.top_levels LEFT JOIN proofs q ON q.row_id = p.row_id
"""
