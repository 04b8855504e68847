"""A plain evaluator of the expression language, row by row: what the columns are held against in tests."""

from __future__ import annotations

import math
import re

from .syntax import Node, parse


def blank(v) -> bool:
    return v is None or v == "" or (isinstance(v, float) and math.isnan(v)) or (isinstance(v, list) and not v)


def number(v):
    if blank(v) or isinstance(v, (bool, list)):
        return None
    try:
        n = float(v)
    except ValueError:
        return None
    return n if math.isfinite(n) else None


def text(v):
    if blank(v) or isinstance(v, (bool, list)):
        return None
    return (str(int(v)) if float(v).is_integer() else str(v)) if isinstance(v, (int, float)) else v


def same(a, b) -> bool:
    if blank(a) or blank(b):
        return blank(a) and blank(b)
    x, y = number(a), number(b)
    return x == y if x is not None and y is not None else text(a) == text(b) if not isinstance(a, bool) else a is b


def finite(f):
    try:
        v = f()
    except (ValueError, ZeroDivisionError, OverflowError):
        return None
    return v if isinstance(v, float) and math.isfinite(v) else None


def evaluate(node: Node | str, row: dict):
    """The value of an expression for one row (names as written)."""
    if isinstance(node, str):
        node = parse(node)
    k, a = node.kind, node.args
    ev = lambda n: evaluate(n, row)
    if k == "field":
        v = row[a[0]]
        return None if blank(v) else v
    if k in ("number", "text", "bool"):
        return a[0] if a[0] != "" else None
    if k == "blank":
        return None
    if k == "negative":
        n = number(ev(a[0]))
        return None if n is None else -n
    if k == "arithmetic":
        x, y = number(ev(a[1])), number(ev(a[2]))
        if x is None or y is None:
            return None
        return finite(lambda: {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[a[0]]())
    if k == "compare":
        x, y = ev(a[1]), ev(a[2])
        if a[0] in ("=", "!="):
            return same(x, y) == (a[0] == "=")
        if blank(x) or blank(y):
            return None
        p, q = number(x), number(y)
        if p is None or q is None:
            p, q = text(x), text(y)
        return {"<": p < q, "<=": p <= q, ">": p > q, ">=": p >= q}[a[0]]
    if k == "and":
        return ev(a[0]) is True and ev(a[1]) is True
    if k == "or":
        return ev(a[0]) is True or ev(a[1]) is True
    if k == "not":
        return ev(a[0]) is not True
    if k == "contains":
        x, y = text(ev(a[0])), text(ev(a[1]))
        return x is not None and y is not None and y in x
    if k == "in":
        x = text(ev(a[0]))
        return x is not None and x in [text(ev(m)) for m in a[1]]
    if k == "matches":
        x = text(ev(a[0]))
        return x is not None and re.search(a[1], x) is not None
    return call(a[0], [ev(x) for x in a[1]])


def call(name: str, v: list):
    n, t = [number(x) for x in v], [text(x) for x in v]
    one = {
        "int": math.trunc, "floor": math.floor, "ceil": math.ceil, "abs": abs, "log": math.log, "log10": math.log10, "exp": math.exp, "sqrt": math.sqrt,
    }
    if name in one:
        return None if n[0] is None else finite(lambda: float(one[name](n[0])))
    if name == "round":
        f = 10.0 ** int(n[1] if len(n) > 1 else 0)
        return None if n[0] is None else math.floor(n[0] * f + 0.5) / f
    if name == "mod":
        return None if None in n or n[1] == 0 else n[0] - n[1] * math.floor(n[0] / n[1])
    if name == "pow":
        return None if None in n else finite(lambda: float(n[0] ** n[1]) if not isinstance(n[0] ** n[1], complex) else math.nan)
    if name == "bin":
        o = n[2] if len(n) > 2 else 0.0
        return None if None in n or n[1] <= 0 else math.floor((n[0] - o) / n[1]) * n[1] + o
    if name == "clamp":
        return None if None in n else min(max(n[0], n[1]), n[2])
    if name in ("min", "max"):
        some = [x for x in n if x is not None]
        return (min if name == "min" else max)(some) if some else None
    if name in ("year", "month", "day"):
        m = re.match(r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", t[0] or "")
        return number(m[("year", "month", "day").index(name) + 1]) if m else None
    if name == "if":
        return v[1] if v[0] is True else v[2]
    if name == "coalesce":
        return next((x for x in v if not blank(x)), None)
    if name == "ifnum":
        return n[0] if n[0] is not None else n[1]
    if name == "nullif":
        return None if same(*v) else v[0]
    if name in ("isblank", "isfilled"):
        return blank(v[0]) == (name == "isblank")
    if name == "isnum":
        return n[0] is not None
    if name == "isnan":
        return not blank(v[0]) and n[0] is None
    if name == "concat":
        return "".join(x for x in t if x is not None) or None
    if t[0] is None:
        return None
    if name == "len":
        return float(len(t[0]))
    if name == "replace":
        return t[0].replace(t[1], t[2] or "") or None
    k = [int(x) if x is not None else 0 for x in n]
    out = {
        "upper": t[0].upper, "lower": t[0].lower, "trim": lambda: t[0].strip(" "), "left": lambda: t[0][: k[1]], "right": lambda: t[0][-k[1] :] if k[1] else "",
        "substr": lambda: t[0][k[1] - 1 : k[1] - 1 + k[2]] if len(k) > 2 else t[0][k[1] - 1 :],
    }
    return out[name]() or None
