"""The node filter language: NODES WHERE field op value [AND ...], compiled to a Column.

Fields: package, type, domain, file, name, exported, fanin, fanout. For file and package, = means "contains" and != its
negation; other strings compare whole; case never counts. fanin and fanout take all six comparisons.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("package", "type", "domain", "file", "name", "exported", "fanin", "fanout")
DEGREES = ("fanin", "fanout")
LIMIT = 1000
_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*")|(?P<op>!=|>=|<=|=|>|<)|(?P<number>\d+(?![\w./-]))|(?P<word>[A-Za-z_./-][\w./-]*|\d[\w./-]*))""")


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: str


def tokenize(query: str) -> list[tuple[str, str, int]]:
    """(kind, value, position); a bad character raises ValueError with its position."""
    out, at = [], 0
    while at < len(query):
        m = _TOKEN.match(query, at)
        if m is None:
            rest = query[at:].lstrip()
            if not rest:
                break
            where = len(query) - len(rest)
            raise ValueError(f"unterminated string at {where}" if rest[0] == '"' else f"unexpected character {rest[0]!r} at {where}")
        kind = m.lastgroup
        value = m[kind]
        out.append((kind, re.sub(r'\\(["\\])', r"\1", value[1:-1]) if kind == "text" else value, m.start(kind)))
        at = m.end()
    return out


def parse(query: str) -> list[Condition]:
    found = tokenize(query)
    keyword = lambda k, word: k < len(found) and found[k][0] == "word" and found[k][1].upper() == word
    if not keyword(0, "NODES"):
        raise ValueError("a query starts with NODES")
    if not keyword(1, "WHERE"):
        raise ValueError(f"WHERE is expected at {found[1][2] if len(found) > 1 else len(query)}")
    out, k = [], 2
    while True:
        if len(found) < k + 3:
            raise ValueError("a condition is: field op value")
        (kind, field, at), (op_kind, op, op_at), (value_kind, value, value_at) = found[k : k + 3]
        field = field.lower()
        if kind != "word" or field not in FIELDS:
            raise ValueError(f"unknown field {field!r} at {at}; fields are {', '.join(FIELDS)}")
        if op_kind != "op":
            raise ValueError(f"an operator is expected at {op_at}")
        if field in DEGREES:
            if value_kind != "number":
                raise ValueError(f"{field} takes a number, at {value_at}")
        elif op not in ("=", "!="):
            raise ValueError(f"{op} is for {' and '.join(DEGREES)} only, at {op_at}")
        if field == "exported" and value.lower() not in ("true", "false"):
            raise ValueError(f"exported takes true or false, at {value_at}")
        out.append(Condition(field, op, value))
        k += 3
        if k == len(found):
            return out
        if not keyword(k, "AND"):
            raise ValueError(f"AND is expected at {found[k][2]}")
        k += 1


def compiled(condition: Condition) -> Column:
    field, op, value = condition.field, condition.op, condition.value
    if field in DEGREES:
        number = F.lit(int(value))
        return {"=": F.col(field) == number, "!=": F.col(field) != number, ">": F.col(field) > number, ">=": F.col(field) >= number, "<": F.col(field) < number, "<=": F.col(field) <= number}[op]
    if field == "exported":
        hit = F.col(field) == F.lit(value.lower() == "true")
    elif field in ("file", "package"):
        hit = F.contains(F.lower(field), F.lit(value.lower()))
    else:
        column = F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit("code")) if field == "domain" else F.col(field)
        hit = F.lower(column) == value.lower()
    return hit if op == "=" else ~hit


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with fanin and fanout over all edge types: one shuffle of both endpoints with partial counts."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    counted = ends.groupBy("id").agg(F.sum("i").alias("fanin"), F.sum("o").alias("fanout"))
    return nodes.join(counted, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in DEGREES})


def select_nodes(query: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All matching nodes with their degrees; conditions that need no degrees are applied before those are counted."""
    conditions = parse(query)
    plain = [compiled(c) for c in conditions if c.field not in DEGREES]
    kept = nodes.where(reduce(lambda a, b: a & b, plain)) if plain else nodes
    out = degrees(kept, edges)
    degree = [compiled(c) for c in conditions if c.field in DEGREES]
    return out.where(reduce(lambda a, b: a & b, degree)) if degree else out


def query_page(query: str, nodes: DataFrame, edges: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """The first `limit` matches by id, and the number of all matches."""
    found = select_nodes(query, nodes, edges)
    return found.orderBy("id").limit(limit), found.count()
