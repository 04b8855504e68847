"""Predicates as JSON or short text. Comparisons with a null are false, ``not`` is a plain complement."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .syntax import Expression, Node, SyntaxFault, lex

OPS = {"==": "=", "=": "=", "!=": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def value(x) -> Column:
    """A literal, ``{"col": name}`` or ``{"arith": [op, a, b]}``."""
    if isinstance(x, dict) and "arith" in x:
        o, a, b = x["arith"]
        a, b = value(a), value(b)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.try_mod(a, b)}[o]()
    if isinstance(x, dict):
        return F.col(x["col"])
    return F.lit(x)


def compare(o: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[OPS[o]]


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def build(spec: dict) -> Column:
    if "and" in spec:
        parts = [build(s) for s in spec["and"]]
        out = F.lit(True)
        for p in parts:
            out &= p
        return out
    if "or" in spec:
        out = F.lit(False)
        for s in spec["or"]:
            out |= build(s)
        return out
    if "not" in spec:
        return ~two_valued(build(spec["not"]))
    if "in" in spec or "notin" in spec:
        name, members = spec.get("in") or spec["notin"]
        found = F.col(name).isin(*members)
        return found if "in" in spec else ~two_valued(found)
    if "between" in spec:
        name, low, high = spec["between"]
        return F.col(name).between(low, high)
    if "isnull" in spec:
        return F.col(spec["isnull"]).isNull()
    if "notnull" in spec:
        return F.col(spec["notnull"]).isNotNull()
    if "truthy" in spec:
        c = F.col(spec["truthy"])
        return two_valued(c.try_cast("boolean") | (c.try_cast("double") != 0))
    if "op" not in spec:
        raise SyntaxFault(f"unknown predicate {sorted(spec)}")
    left = value({"col": spec["col"]}) if "col" in spec else value(spec["left"])
    return compare(spec["op"], left, value(spec["value"]))


def columns_of(spec) -> set[str]:
    if isinstance(spec, dict):
        own = {spec["col"]} if "col" in spec else set()
        for k in ("in", "notin", "between"):
            own |= {spec[k][0]} if k in spec else set()
        own |= {spec[k] for k in ("isnull", "notnull", "truthy") if k in spec}
        return own.union(*(columns_of(v) for v in spec.values() if isinstance(v, (dict, list))))
    return set().union(*(columns_of(v) for v in spec)) if isinstance(spec, list) else set()


def to_column(df: DataFrame, spec: dict | str) -> Column:
    spec = json.loads(spec) if isinstance(spec, str) else spec
    unknown = columns_of(spec) - set(df.columns)
    if unknown:
        raise SyntaxFault(f"no column {sorted(unknown)}")
    return build(spec)


def operand(n: Node):
    if n.kind == "field":
        return {"col": n.args[0]}
    if n.kind in ("number", "text", "bool"):
        return n.args[0]
    if n.kind == "negative" and n.args[0].kind == "number":
        return -n.args[0].args[0]
    if n.kind == "arithmetic":
        return {"arith": [n.args[0], operand(n.args[1]), operand(n.args[2])]}
    raise SyntaxFault(f"{n.kind} is no value")


def spec_of(n: Node) -> dict:
    if n.kind in ("and", "or"):
        return {n.kind: [spec_of(a) for a in n.args]}
    if n.kind == "not":
        return {"not": spec_of(n.args[0])}
    if n.kind == "compare":
        return {"op": {"=": "=="}.get(n.args[0], n.args[0]), "left": operand(n.args[1]), "value": operand(n.args[2])}
    if n.kind == "in":
        return {"in": [n.args[0].args[0], [operand(m) for m in n.args[1]]]}
    if n.kind == "field":
        return {"truthy": n.args[0]}
    raise SyntaxFault(f"{n.kind} is no predicate")


def parse(source: str) -> dict:
    return spec_of(Expression(lex(source)).whole())


def to_text(spec: dict) -> str:
    """Text that parses to the same predicate."""

    def one(x) -> str:
        if isinstance(x, dict):
            return x["col"] if "col" in x else f"({one(x['arith'][1])} {x['arith'][0]} {one(x['arith'][2])})"
        return json.dumps(x)

    for k, word in (("and", " && "), ("or", " || ")):
        if k in spec:
            return "(" + word.join(to_text(s) for s in spec[k]) + ")"
    if "not" in spec:
        return f"!({to_text(spec['not'])})"
    if "in" in spec:
        return f"{spec['in'][0]} in ({', '.join(map(json.dumps, spec['in'][1]))})"
    if "truthy" in spec:
        return spec["truthy"]
    left = spec["col"] if "col" in spec else one(spec["left"])
    return f"{left} {spec['op']} {one(spec['value'])}"


def line_filter(source: str) -> Column:
    """``A ~ text && B >= 3 && C in x, y``: clauses joined by &&; ~ contains without regard to case."""
    import re

    out = F.lit(True)
    for clause in source.split("&&"):
        m = re.match(r"\s*(\S+)\s*(!~|~|<=|>=|!=|==|=|<|>|in\b)\s*(.*?)\s*$", clause)
        if not m:
            raise SyntaxFault(f"no clause: {clause!r}")
        c, o, v = F.col(m[1]), m[2], m[3].strip("\"'")
        if o in ("~", "!~"):
            found = F.contains(F.lower(c.cast("string")), F.lit(v.lower()))
            out &= found if o == "~" else ~two_valued(found)
        elif o == "in":
            out &= c.cast("string").isin(*[x.strip().strip("\"'") for x in v.split(",")])
        else:
            try:
                out &= compare(o, c.try_cast("double"), F.lit(float(v)))
            except ValueError:
                out &= compare(o, c.cast("string"), F.lit(v))
    return out
